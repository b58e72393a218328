"""Solidity lines from which the driver tables are turned into source files.

For every rule there is at least one line that triggers it and, where a rule
looks around, one that silences it.  ``{K}`` becomes a file number.
"""

LINES = [
    "pragma solidity ^0.7.6;",
    "pragma solidity 0.8.4;",
    "pragma solidity >=0.5.0;",
    "// SPDX-License-Identifier: MIT",
    'import "./C{K}.sol";',
    'import {Vault} from "../core/C{K}.sol";',
    'import "@token/ERC20.sol";',
    "contract Vault is Ownable {",
    "interface IOracle {",
    "library Math {",
    "mapping(address => uint256) public balances;",
    "struct Pool { uint256 total; }",
    "event Paid(address who);",
    "constructor() {",
    "}",
    "",
    "    uint256 x = a + b;",
    '(bool ok,) = to.call{value: a}("");',
    '(bool sent,) = to.call{ value: a}("");',
    "function take(uint256 a) external nonReentrant {",
    "balances[msg.sender] -= a;",
    "total = total + 1;",
    "require(success);",
    "require(sent, \"no\");",
    "receive() external payable {",
    "fallback() external {",
    "targetPool.poke(1);",
    "function quote() external view returns (uint256) {",
    "pool.get_virtual_price();",
    "pool.remove_liquidity(1);",
    "function withdrawAll(address to) external {",
    "function mintTo(address to) public onlyRole {",
    "function setFee(uint256 fee) public {",
    "feeRate = newFee;",
    "if (tx.origin == msg.sender) {",
    "require(tx.origin == owner);",
    "/* tx.origin in words",
    "* selfdestruct in words",
    "selfdestruct(payable(owner));",
    "suicide(owner);",
    "function setOwner(address o) public {",
    "function transferOwnership(address o) external onlyOwner {",
    "function initialize() external {",
    "function init(address a) public initializer {",
    "initialized = true;",
    "assembly {",
    "sstore(slot, value)",
    "unchecked { x = a - b; }",
    "unchecked {",
    "supplyCap *= rate2;",
    "using SafeMath for uint256;",
    "uint64 t = uint64(block.number);",
    "uint256 r = (a / b) * c;",
    "uint256 r = a / b * c;",
    "uint256 p = amount / 1e18;",
    "uint256 share = assets / total;",
    "price = reserve / supply;",
    "token.call(data);",
    "assert(ok);",
    "impl.delegatecall(data);",
    "to.transfer(1 ether);",
    "to.send(a);",
    "token.transfer(to, a);",
    "token.safeTransfer(to, a);",
    "(r0, r1,) = pair.getReserves();",
    "uint256 b = token.balanceOf(address(this));",
    "function flashLoan(uint256 a) external {",
    "flashMint(a);",
    "router.swapExactTokens(a, b);",
    "uint256 amountOutMin = 5;",
    "uint256 deadline = block.timestamp;",
    "exactInput(params);",
    "amountOutMinimum: 0,",
    "router.swap(a, 0, b);",
    "(, int256 answer,,,) = feed.latestRoundData();",
    "require(updatedAt > 0);",
    "Pool storage pool;",
    "Pool storage p = pools[0];",
    "address public implementation;",
    "contract MyProxy is BaseProxy {",
    "contract Up is OwnableUpgradeable {",
    "    address private admin;",
    "    uint256 internal total; // slot",
    "    bytes32 private constant SLOT = 0;",
    "    bytes32 internal implSlot = keccak256(\"impl\");",
    "    function run() internal {",
    "if (address(this).balance == 1) {",
    "items.length -= 1;",
    "require(balanceOf(a) == 5);",
    "if (totalSupply == 0) {",
    "if (token.balanceOf(x) == 3) {",
    "uint256 seed = uint256(blockhash(1));",
    "uint256 t = block.timestamp;",
    "address s = ecrecover(h, v, r, q);",
    "require(s != address(0));",
    "uint256 id = block.chainid;",
    "token.transferFrom(a, b, c);",
    "uint256 balBefore = token.balanceOf(a);",
    "IERC777 t7;",
    "function tokensReceived(bytes calldata d) external {",
    "contract G is ReentrancyGuard {",
    "function setAdminAddress(address a) external {",
    "require(a != address(0));",
    "token.approve(to, a);",
    "token.safeApprove(to, a);",
    "token.approve(to, type(uint256).max);",
    "_mint(to, a);",
    "function mintX(uint256 a) external onlyOwner {",
    "function onSwap(uint256 a) external {",
    "reserveTokenIn += a;",
    "contract I is Initializable {",
    "_disableInitializers();",
    "function propose(uint256 a) external {",
    "uint256 snapshotId = 1;",
    "function castVote(uint256 a) public {",
    "if (totalShares == 0) {",
    "uint256 s = totalSupply * token.balanceOf(v);",
    "deadline: block.timestamp,",
    "deadline: type(uint256).max,",
    "function onFlashLoan(address a) external {",
    "require(msg.sender == pool);",
    "function bridge(address target) public {",
    "for (uint i = 0; i < users.length; i++) {",
    "for (uint256 i = 0; i < sigs.length; i++) {",
    "for (j = 0; j < 5; j++) {",
    "verify(sigs[i]);",
    "}",
    "require(ok[i]);",
    "} // each",
    "}}",
    "payee.transfer(a);",
    "to.call{gas: 5}(d);",
    "bytes32 h = keccak256(abi.encodePacked(a, b));",
    "bytes memory q = abi.encodePacked(a);",
    "delete users[0];",
    "delete pool;",
    "return;",
    "owner = msg.sender;",
    "emit Paid(owner);",
    "paused = true;",
    "    string private password;",
    "string baseURI = \"ipfs://x\";",
    "contract N is ERC721 {",
    "tstore(0x01, 1)",
    "tstore(300, 2)",
    "uint256 size; extcodesize(a)",
    "if (isContract(a)) {",
    "list.push(1);",
    "bytes data;",
    "function put(uint256 a) external {",
    "function pay(address a) public {",
    "require(msg.value >= price);",
    "revert();",
    "if (a > b) {",
    "uint256 y = 2;",
    "address to = msg.sender;",
    "uint256 fee = amount * bps;",
    "emit Done();",
    "modifier initializer() {",
    "x++;",
    "bool ok = true;",
    "permission = 1;",
    "oracle.index();",
    "uint256 n = users.length;",
    "",
    "    // keep going",
    "string memory s;",
]
