"""One text that fires and one that does not per rule branch."""

import pytest
from pyspark.sql import functions as F

from codesift.operators.scan import rule_scan
from codesift.rules import solidity
from codesift.rules.solidity import MESSAGES

OLD, NEW = "pragma solidity 0.5.0;", "pragma solidity 0.8.20;"
CALL = '(bool ok,) = to.call{value: a}("");'

# branch -> (firing lines, quiet lines)
CASES = {
    "ETH-001": ([CALL, "balances[x] = 1;"], ["nonReentrant", CALL, "balances[x] = 1;"]),
    "ETH-004a": (["receive() external payable {", "victimPool.take(1);"], ["receive() external payable {", "}"]),
    "ETH-004b": (["function q() external view {", "get_virtual_price", "remove_liquidity"], ["function q() external view {", "get_virtual_price"]),
    "ETH-006": (["function withdraw() external {", "x = 1;"], ["function withdraw() external onlyOwner {", "x = 1;"]),
    "ETH-007": (["require(tx.origin == a);"], ["// require(tx.origin == a);"]),
    "ETH-008": (["selfdestruct(a);"], ["destroy(a);"]),
    "ETH-009": (["function setOwner(address o) {"], ["function setOwner(address o) onlyOwner {"]),
    "ETH-010": (["function init() public {"], ["function init() public {", "require(!initialized);"]),
    "ETH-012": (["assembly {", "sstore(0, 1)"], ["sstore(0, 1)"]),
    "ETH-013a": (["unchecked {", "x = a + b;"], ["unchecked {", "x = a;"]),
    "ETH-013b": ([OLD, "x += y;"], [OLD, "using SafeMath for uint;", "x += y;"]),
    "ETH-013c": (["uint8 x = uint8(y);"], ["function f() { uint8(y); }"]),
    "ETH-014": (["x = a / b * c;"], ["x = a * c / b;"]),
    "ETH-017a": (["x = a / 1e18"], ["x = a / 1e1"]),
    "ETH-017b": (["price", "x = a / b;"], ["x = a / b;"]),
    "ETH-018": (["t.call(d);", "a", "b", "c", "require(ok)"], ["t.call(d);", "a", "b", "require(ok)"]),
    "ETH-019": (["x.delegatecall(d);"], ["x.call(d);"]),
    "ETH-021a": (["for", "a.transfer(1);"], ["a.transfer(1);"]),
    "ETH-021b": ([CALL, "require(ok, 1);"], [CALL, "require(", "ok, 1);"]),
    "ETH-024a": (["p.getReserves();", "borrow"], ["p.getReserves();"]),
    "ETH-024b": (["t.balanceOf(address(this));", "oracle"], ["t.balanceOf(address(this));"]),
    "ETH-025": (["function FLASHLOAN("], ["function loan("]),
    "ETH-026": (["r.swap(a);"], ["amountOutMin", "r.swap(a);", "deadline"]),
    "ETH-027": (["amountOutMin: 0,"], ["amountOutMin: 1,"]),
    "ETH-028": (["f.latestRoundData();"], ["f.latestRoundData();", "updatedAt"]),
    "ETH-029": (["Pool storage p;"], ["Pool storage p = q;"]),
    "ETH-030a": (["a.delegatecall(d);", "implementation"], ["a.delegatecall(d);"]),
    "ETH-030b": (["contract A is MyProxy {", "  address private x;"], ["contract A is MyProxy {", "  function f()", "  address private x;"]),
    "ETH-030c": (["bytes32 private mySLOT = keccak256(1);"], ["bytes32 private constant mySLOT = keccak256(1);"]),
    "ETH-032": (["x = address(this).balance == 1"], ["x = address(this).balance > 1"]),
    "ETH-033a": ([OLD, "a.length = 0;"], [NEW, "a.length = 0;"]),
    "ETH-033b": (["assembly", "sstore(1)"], ["sstore(1)"]),
    "ETH-034": (["if (totalSupply == 0)"], ["if (totalSupply > 0)"]),
    "ETH-037": (["block.timestamp", "lottery"], ["block.timestamp"]),
    "ETH-038": (["ecrecover(h)"], ["ecrecover(h)", "x != address(0)"]),
    "ETH-039": (["ecrecover(h)"], ["ecrecover(h)", "block.chainid"]),
    "ETH-041": (["t.transfer(a, b);"], ["t.transfer(a, b);", "safeTransfer(x)"]),
    "ETH-042": (["", "t.transferFrom(a);", "", "", "", "", "", "", "balanceOf"], ["", "t.transferFrom(a);", "", "", "", "", "", "balanceOf"]),
    "ETH-044": (["IERC777 t;"], ["IERC777 t;", "nonReentrant"]),
    "ETH-045": (["function setAdmin(address a) external {"], ["function setAdmin(address a) external {", "require(a != address(0));"]),
    "ETH-046": (["t.approve(a);"], ["t.safeApprove(a);"]),
    "ETH-047": (["t.approve(type(uint256).max)"], ["t.approve(1)"]),
    "ETH-048a": (["_mint(a);"], ["only", "", "", "_mint(a);"]),
    "ETH-048b": (["function onSwap("], ["function swapOn("]),
    "ETH-049": (["Initializable", "function initialize"], ["Initializable", "function initialize", "_disableInitializers"]),
    "ETH-055": (["function castVote("], ["function castVote(", "snapshot"]),
    "ETH-057a": (["if (totalShares == 0) mint"], ["if (totalShares == 0)".replace("Shares", "Units")]),
    "ETH-057b": (["totalSupply * balanceOf vault"], ["totalSupply * balanceOf"]),
    "ETH-060a": (["deadline: block.timestamp"], ["deadline: t"]),
    "ETH-060b": (["amountOutMinimum: 0"], ["amountOutMinimum: 5"]),
    "ETH-064": (["function onFlashLoan("], ["function onFlashLoan(", "require(msg.sender == a)"]),
    "ETH-065": (["function f(address router)"], ["function f(address who)"]),
    "ETH-066": (["for (i; i < a.length;)"], ["while (i < a.length)"]),
    "ETH-071": (["pragma solidity ^0.8.1;"], ["pragma solidity 0.8.1;"]),
    "ETH-072": (["pragma solidity 0.6.1;"], ["pragma solidity 0.8.1;"]),
    "ETH-073": (["abi.encodePacked(a, b)"], ["abi.encodePacked(a)"]),
    "ETH-075a": (["delete a[1];"], ["delete a;"]),
    "ETH-075b": (["delete a;", "struct mapping"], ["delete a;"]),
    "ETH-075c": (["for (uint i = 0; i < s.length; i++) {", "verify(s[i]);", "}", "a.send(1);"],
                 ["for (uint i = 0; i < s.length; i++) {", "verify(s[i]);", "}", "", "", "", "", "a.send(1);"]),
    "ETH-075d": (["for (a) {", "for (b) {", "return;"], ["for (a) {", "return;"]),
    "ETH-076": (["owner = a;"], ["owner = a;", "emit X();"]),
    "ETH-078a": (["  uint private x;"], ["  uint public x;"]),
    "ETH-078c": (["ipfs://", "nft"], ["ipfs://"]),
    "ETH-079": (["a.send(1);"], ["a.call(1);"]),
    "ETH-081": (["tstore(0x01, a)"], ["tstore(slot, a)"]),
    "ETH-086": (["require(tx.origin == msg.sender)"], ["tx.origin, msg.sender"]),
    "ETH-089": (["a.isContract()"], ["a.code"]),
    "ETH-097": (["pragma solidity 0.8.14;", "bytes b; b.push(1);"], ["pragma solidity 0.8.15;", "bytes b; b.push(1);"]),
    "ETH-098a": (["function f(uint a) external {"], ["function f(uint a) external {", "revert E();"]),
    "ETH-098b": (["for (a) {", "require(msg.value >= p);"], ["require(msg.value >= p);"]),
}


@pytest.fixture(scope="module")
def leads(spark):
    rows = [("p", f"{key}/{kind}.sol", "\n".join(lines), "solidity")
            for key, pair in CASES.items() for kind, lines in zip(("yes", "no"), pair)]
    df = spark.createDataFrame(rows, "project_id string, path string, content string, language string")
    texts = {(k[:7], m[3].split("{}")[0]): k for k, m in MESSAGES.items()}
    found = set()
    for r in rule_scan(df).collect():
        for (rule, text), key in texts.items():
            if rule == r["pattern_id"] and r["signal"].startswith(text):
                found.add((r["file"], key))
    return found


def test_all_branches_are_covered():
    # The plain private variable is always taken by the branch before it.
    assert set(MESSAGES) - set(CASES) == {"ETH-078b"}


@pytest.mark.parametrize("key", sorted(CASES))
def test_branch(leads, key):
    assert (f"{key}/yes.sol", key) in leads
    assert (f"{key}/no.sol", key) not in leads


def test_once_per_file_and_place(spark):
    text = "\n".join(["t.approve(a);", "t.approve(b);", "a.send(1);", "a.send(2);", "contract A is MyProxy {", "  // note", "  address private x;"])
    df = spark.createDataFrame([("p", "a.sol", text, "solidity"), ("p", "b.rs", text, "rust")],
                               "project_id string, path string, content string, language string")
    got = {(r["pattern_id"], r["line"]) for r in rule_scan(df).collect()}
    assert {("ETH-046", 1), ("ETH-079", 3), ("ETH-079", 4), ("ETH-030", 7)} <= got
    assert ("ETH-046", 2) not in got


def test_known_lines(spark):
    """Published leads of one contract whose lines can be replayed alone."""
    lines = {2: "pragma solidity ^0.8.30;", 176: "require(block.timestamp < _deadline, InvalidDeadline());", 206: "createdAt: block.timestamp,",
             260: "for (uint256 i = 0; i < multiplierPackages.length; i++) {", 300: "uint256 seed;"}
    text = "\n".join(lines.get(i, "") for i in range(1, 301))
    df = spark.createDataFrame([("p", "src/Redacted-Contract.sol", text, "solidity")],
                               "project_id string, path string, content string, language string")
    got = {(r["pattern_id"], r["line"], r["severity"], r["confidence"]) for r in rule_scan(df).collect()}
    assert {("ETH-071", 2, "LOW", 0.95), ("ETH-037", 176, "HIGH", 0.75), ("ETH-037", 206, "HIGH", 0.75), ("ETH-066", 260, "HIGH", 0.7)} <= got


def test_segments_do_not_matter(spark, monkeypatch):
    from codesift.operators import scan

    text = "\n".join(line for pair in CASES.values() for line in pair[0])
    df = spark.createDataFrame([("p", "a.sol", text, "solidity")], "project_id string, path string, content string, language string")
    whole = {tuple(r) for r in scan.rule_scan(df).collect()}
    monkeypatch.setattr(scan, "SEGMENT", 5)
    assert {tuple(r) for r in scan.rule_scan(df).collect()} == whole


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_content_is_built_once(spark):
    from codesift.operators.features import featurize_files
    from codesift.workloads.corpus import files_of

    docs = spark.createDataFrame([(5, "some words of a text", "src1", 20), (10, None, "src1", 20)], "doc_id long, text string, source string, n_chars long")
    found = rule_scan(featurize_files(files_of(docs)))
    assert _plan(found).count("array_join(transform(") == 1
    assert found.filter("file like '%C10.%'").count() == 0


def test_few_rules_leave_lines_early_and_find_the_same(spark):
    lines = ["pragma solidity ^0.7.0;", "contract A is BaseProxy {", "  address private owner;", "for (uint i = 0; i < a.length; i++) {", "  require(b[i] == {x: 1}.x);",
             "  to.transfer(b[i]);", "}", "delete a[3];", "for (uint i = 0; ; ) {", "for (uint j = 0; ; ) {", "return;", "", "int z = 1;"]
    files = spark.createDataFrame([("p", "a.sol", "\n".join(lines * 12), "solidity"), ("p", "b.sol", None, "solidity"), ("p", "c.sol", "", "solidity")],
                                  "project_id string, path string, content string, language string")
    every = rule_scan(files).cache()
    for rule in ("ETH-075", "ETH-030", "ETH-071"):
        few = rule_scan(files, {rule})
        assert few.count() > 0
        assert sorted(map(str, few.collect())) == sorted(map(str, every.filter(f"pattern_id = '{rule}'").collect()))
    assert all(" OR coalesce(" in _plan(rule_scan(files, {rule})) for rule in ("ETH-075", "ETH-030"))


def test_braces_are_counted_without_a_pattern(spark):
    from codesift.rules.solidity import _count

    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("{a{}",), ("",), ("\u00fc{\U0001f600}",), (None,)], "t string")
    got = rows.select(_count(F.col("t"), "{"), F.regexp_count("t", F.lit(r"\{"))).collect()
    assert all(a == b for a, b in got) and got[0][0] == 2


def test_words_are_looked_for_without_patterns(spark):
    facts = solidity.file_facts()
    assert not [name for name, c in facts.items() if "rlike" in str(c).lower()]
    plain = [b.key for b in solidity.solidity_branches(lambda lo, hi: F.lit("")) if "rlike" in str(b.anchor).lower() and "case when" not in str(b.anchor).lower()]
    assert not plain  # a pattern is tried only where a word of it stands


def test_no_slot_variable(spark):
    texts = ["x", "  uint256 private a;", "y\n  uint256 private a;", " private x", "contract\n"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", solidity.slot_variable_offset(F.col("t")).alias("at")).collect()
    assert [r["at"] for r in sorted(got)] == [-1, 0, 1, -1, -1]
