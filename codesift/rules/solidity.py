"""Solidity rule pack: which lines are suspicious, and what is said about them.

A rule is a list of branches.  Branches are tried in order and at most one
fires per line.  ``once`` branches report only the first line of a file.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from codesift.functions.text import trimmed


@dataclass(frozen=True)
class Branch:
    """``anchor`` looks at the line and at file facts only; ``context`` may look
    around and is evaluated only where the anchor holds."""

    key: str
    anchor: Column
    context: Column | None = None
    once: bool = False
    detail: Column | None = None

    @property
    def rule_id(self) -> str:
        return self.key[:7]

    @property
    def when(self) -> Column:
        # Not an AND: what the sides of several ANDs share is computed beforehand, for every line.
        return self.anchor if self.context is None else F.when(self.anchor, self.context)


# ---------------------------------------------------------------------------
# Severity, confidence, category, signal and verify text of each
# branch.  "{}" in a signal stands for the detail captured from the line.
MESSAGES: dict[str, tuple[str, float, str, str, str]] = {
    "ETH-001": ("CRITICAL", 0.8, "reentrancy",
        "External call with value transfer detected BEFORE state update (CEI violation)",
        "Is nonReentrant present on this function? Is state (pool.reserved, balances, etc.) updated BEFORE this call?"),
    "ETH-004a": ("HIGH", 0.7, "reentrancy",
        "Callback (receive/fallback) reads external state during reentrancy window.",
        "Use reentrancy-aware oracles or check reentrancy lock in view functions."),
    "ETH-004b": ("HIGH", 0.65, "reentrancy",
        "View function returns state dependent on external oracle, exploitable during reentrancy.",
        "Use reentrancy-aware oracles or check reentrancy lock in view functions."),
    "ETH-006": ("CRITICAL", 0.7, "access-control",
        "Sensitive function '{}' modifies state without access control modifier",
        "Is access control enforced via a modifier, require(), or caller validation anywhere in this function or its callers?"),
    "ETH-007": ("CRITICAL", 0.9, "access-control",
        "tx.origin used for authentication — phishable via intermediate contract",
        "Replace tx.origin with msg.sender. Is there any legitimate use case here?"),
    "ETH-008": ("HIGH", 0.75, "access-control",
        "selfdestruct found. Check access control and proxy implications.",
        "Ensure selfdestruct has proper access control. Consider removing if not needed."),
    "ETH-009": ("CRITICAL", 0.85, "access-control",
        "Ownership change function accessible without access control.",
        "Add onlyOwner modifier to restrict access."),
    "ETH-010": ("CRITICAL", 0.85, "proxy",
        "Public init/initialize function without initializer modifier. Anyone can call it to take ownership.",
        "Add OpenZeppelin initializer modifier or require(!initialized) check."),
    "ETH-012": ("HIGH", 0.65, "access-control",
        "Assembly sstore — Potential Backdoor. Direct storage write may indicate hidden state manipulation.",
        "Review assembly sstore usage. Ensure no unauthorized storage modifications."),
    "ETH-013a": ("HIGH", 0.7, "arithmetic",
        "unchecked {} block disables overflow/underflow protection",
        "Are all values inside this block guaranteed by invariants to never overflow? Are any user-controlled inputs involved?"),
    "ETH-013b": ("HIGH", 0.8, "arithmetic",
        "Arithmetic Without Overflow Protection (pre-0.8.0). No SafeMath detected.",
        "Upgrade to Solidity >= 0.8.0 or use OpenZeppelin SafeMath library."),
    "ETH-013c": ("HIGH", 0.7, "arithmetic",
        "Unsafe integer downcast to uint{} may silently truncate larger values.",
        "Use OpenZeppelin SafeCast library or validate value fits in target type."),
    "ETH-014": ("MEDIUM", 0.7, "arithmetic",
        "Division before multiplication causes precision loss due to integer truncation.",
        "Reorder to multiply first: (a * c) / b instead of (a / b) * c."),
    "ETH-017a": ("MEDIUM", 0.7, "arithmetic",
        "Division by very large denominator (1eN). Small numerators will round to zero.",
        "Use higher precision intermediates or mulDiv for precise division."),
    "ETH-017b": ("MEDIUM", 0.55, "arithmetic",
        "Integer division truncates result. May cause precision loss in financial calculations.",
        "Use higher precision intermediates or mulDiv for precise division."),
    "ETH-018": ("HIGH", 0.7, "external-calls",
        "Low-level .call() return value not checked in next 4 lines",
        "Is the success boolean captured and checked? A failing call silently continues."),
    "ETH-019": ("CRITICAL", 0.75, "external-calls",
        "delegatecall executes code in caller's storage context",
        "Is the delegatecall target a trusted, immutable address? Can an attacker control the target address?"),
    "ETH-021a": ("HIGH", 0.7, "gas-dos",
        ".transfer()/.send() in loop context. Single failure reverts entire batch.",
        "Use pull-payment pattern. Let recipients withdraw instead of pushing funds."),
    "ETH-021b": ("HIGH", 0.65, "gas-dos",
        "External call with required success. If callee reverts, function is permanently blocked.",
        "Use pull-payment pattern or continue on failure. Don't require external call success."),
    "ETH-024a": ("CRITICAL", 0.8, "oracle",
        "getReserves() spot price used for financial calculation — flash-loan manipulable in same tx",
        "Is a TWAP oracle or Chainlink feed used instead of spot price? Is there same-block manipulation protection?"),
    "ETH-024b": ("CRITICAL", 0.8, "oracle",
        "balanceOf(address(this)) used for pricing — manipulable via donation or flash loan",
        "Is a TWAP oracle or Chainlink feed used instead of spot price? Is there same-block manipulation protection?"),
    "ETH-025": ("HIGH", 0.65, "oracle",
        "Flash loan function detected. Verify all dependent state is flash-loan resistant.",
        "Add same-block protection. Ensure oracle prices are not manipulable within a single tx."),
    "ETH-026": ("HIGH", 0.7, "defi",
        "Swap operation without slippage protection or deadline. Vulnerable to sandwich attacks.",
        "Add minimum output amount and transaction deadline parameters."),
    "ETH-027": ("HIGH", 0.85, "defi",
        "Swap accepts zero minimum output — any slippage including total loss is accepted",
        "Can the user specify their own minAmountOut? Is this intentional (gas optimization) or a missing parameter?"),
    "ETH-028": ("HIGH", 0.8, "oracle",
        "Chainlink latestRoundData() called without checking updatedAt for staleness",
        "Is there a require(updatedAt > block.timestamp - MAX_DELAY) check anywhere in this function? Stale price can be used to manipulate protocol."),
    "ETH-029": ("HIGH", 0.65, "storage",
        "Storage pointer declared without initialization. May point to unexpected slot.",
        "Initialize storage pointers explicitly. Use memory for local variables."),
    "ETH-030a": ("CRITICAL", 0.7, "storage",
        "delegatecall in proxy pattern. Storage layout mismatch causes slot collision.",
        "Use EIP-1967 storage slots. Ensure proxy and impl have compatible storage layouts."),
    "ETH-030b": ("CRITICAL", 0.8, "storage",
        "State variable in proxy contract collides with implementation slot 0.",
        "Remove state variables from proxy. Use EIP-1967 storage slots."),
    "ETH-030c": ("CRITICAL", 0.85, "storage",
        "Storage slot variable is not constant. Can be overwritten, breaking proxy.",
        "Mark storage slot as constant: bytes32 constant internal _IMPL_SLOT = keccak256(...);"),
    "ETH-032": ("HIGH", 0.8, "logic",
        "Strict equality check on address(this).balance. Attacker can force ETH via selfdestruct to break invariants.",
        "Use >= or <= instead of == for balance checks. Never assume exact balance."),
    "ETH-033a": ("CRITICAL", 0.9, "storage",
        "Direct array .length modification in Solidity < 0.6.0 enables arbitrary storage slot writes via array underflow.",
        "Upgrade to Solidity >= 0.6.0 where direct .length modification is prohibited."),
    "ETH-033b": ("HIGH", 0.7, "storage",
        "Assembly sstore (Potential Arbitrary Storage Write). If slot is user-controllable, enables arbitrary storage overwrites.",
        "Validate storage slot values. Use Solidity state variables instead of raw sstore."),
    "ETH-034": ("HIGH", 0.7, "logic",
        "Strict equality check on balance/supply. Attacker can manipulate via transfer/selfdestruct to break invariant.",
        "Use >= or <= instead of == for balance comparisons."),
    "ETH-037": ("HIGH", 0.75, "logic",
        "Block attributes used as randomness source — miners/validators can manipulate",
        "Is Chainlink VRF or a commit-reveal scheme used? Block attributes are predictable by block producers."),
    "ETH-038": ("HIGH", 0.8, "logic",
        "ecrecover() return value not checked against address(0)",
        "Invalid signatures return address(0). Is that checked? Could an attacker pass a null signature to bypass auth?"),
    "ETH-039": ("CRITICAL", 0.7, "logic",
        "ecrecover used but no block.chainid found in file — signature may be replayable cross-chain",
        "Does the signed hash include block.chainid and this contract address? Missing these allows replay attacks on other chains."),
    "ETH-041": ("HIGH", 0.75, "token",
        "ERC-20 transfer without SafeERC20 — some tokens (USDT) don't return bool",
        "Is SafeERC20 used for this token? Non-compliant tokens that return nothing will cause a revert."),
    "ETH-042": ("HIGH", 0.55, "token",
        "transferFrom without balance diff check — fee-on-transfer tokens deliver less than requested",
        "Does this protocol support fee-on-transfer tokens? If so, check balanceOf before and after to get actual received amount."),
    "ETH-044": ("HIGH", 0.75, "token",
        "ERC-777 token hooks can trigger reentrancy. No ReentrancyGuard detected.",
        "Add nonReentrant modifier or use ERC-20 instead of ERC-777."),
    "ETH-045": ("MEDIUM", 0.65, "token",
        "Setter function for critical address parameter without address(0) validation.",
        "Add require(newAddr != address(0)) before assignment."),
    "ETH-046": ("MEDIUM", 0.6, "token",
        "approve() is vulnerable to front-running race condition.",
        "Use safeIncreaseAllowance/safeDecreaseAllowance or set to 0 first."),
    "ETH-047": ("LOW", 0.75, "token",
        "Unlimited token approval (type(uint256).max). If approved address is compromised, all tokens are at risk.",
        "Approve only the exact amount needed. Use increaseAllowance/decreaseAllowance."),
    "ETH-048a": ("HIGH", 0.65, "token",
        "_mint() called without access control. May allow unauthorized token creation.",
        "Restrict minting to authorized roles with onlyOwner/onlyRole modifier."),
    "ETH-048b": ("HIGH", 0.65, "token",
        "Swap callback uses reserve parameters that can be manipulated via flash loans.",
        "Use TWAP oracle or verify reserves haven't been manipulated in same block."),
    "ETH-049": ("CRITICAL", 0.8, "proxy",
        "Initializable contract without _disableInitializers() in constructor. Implementation can be initialized by attacker.",
        "Add constructor() { _disableInitializers(); } to prevent implementation takeover."),
    "ETH-055": ("HIGH", 0.65, "defi",
        "Governance function without vote snapshotting. Attacker can flash-loan tokens to manipulate votes.",
        "Use ERC20Votes with getPastVotes() and proposal snapshot blocks."),
    "ETH-057a": ("CRITICAL", 0.75, "defi",
        "Share calculation when totalSupply == 0 — first depositor can inflate share price",
        "Is there a virtual offset (ERC-4626 style +1/+1) or minimum dead shares minted at deployment? Without this, first depositor can steal from subsequent depositors."),
    "ETH-057b": ("HIGH", 0.7, "defi",
        "Balance-based share calculation (donation attack risk). Share price derived from balanceOf/totalSupply ratio.",
        "Use internal accounting instead of balanceOf. Add virtual offset or minimum deposit."),
    "ETH-060a": ("MEDIUM", 0.8, "defi",
        "Deadline set to block.timestamp or uint256.max — provides no expiry protection",
        "Should the user be able to specify their own deadline? A hardcoded deadline means transactions can be held and executed at any future price."),
    "ETH-060b": ("HIGH", 0.85, "defi",
        "Zero slippage in swap parameters — accepts any output amount.",
        "Allow user to specify minimum output. Never hardcode to 0."),
    "ETH-064": ("HIGH", 0.65, "defi",
        "Callback function without msg.sender validation",
        "Is msg.sender checked against the expected caller (e.g., the flash loan pool, NFT contract)? Anyone can call this function directly."),
    "ETH-065": ("MEDIUM", 0.6, "defi",
        "Function accepts user-controlled protocol/contract address. Attacker can pass malicious contract.",
        "Whitelist allowed protocol addresses or validate against a registry."),
    "ETH-066": ("HIGH", 0.7, "gas-dos",
        "Loop over dynamic array .length — may exceed block gas limit as array grows",
        "Is there an upper bound on array size? Can an attacker add elements to grief this function?"),
    "ETH-071": ("LOW", 0.95, "miscellaneous",
        "Floating pragma — contract can compile with different compiler versions",
        "Lock to specific version: pragma solidity 0.8.x"),
    "ETH-072": ("LOW", 0.95, "miscellaneous",
        "Using outdated Solidity version. Missing overflow protection and security fixes.",
        "Upgrade to Solidity 0.8.x+ for built-in overflow checks."),
    "ETH-073": ("MEDIUM", 0.65, "logic",
        "abi.encodePacked with multiple args — hash collision possible if any arg is dynamic type",
        "Are any arguments strings, bytes, or dynamic arrays? If so, use abi.encode instead."),
    "ETH-075a": ("MEDIUM", 0.65, "miscellaneous",
        "delete on array element sets to zero but doesn't remove. Leaves gap in array.",
        "Swap with last element and pop, or shift elements left."),
    "ETH-075b": ("MEDIUM", 0.6, "miscellaneous",
        "delete on struct with nested mapping doesn't clear the mapping.",
        "Manually clear mapping entries before deleting struct."),
    "ETH-075c": ("HIGH", 0.75, "miscellaneous",
        "Validation in loop can be bypassed by passing empty array. Action executes regardless.",
        "Add require(array.length > 0) before loop to prevent empty input bypass."),
    "ETH-075d": ("MEDIUM", 0.7, "miscellaneous",
        "return inside nested loop exits entire function. Use break to exit inner loop only.",
        "Replace return with break in inner loop to continue outer loop processing."),
    "ETH-076": ("LOW", 0.55, "miscellaneous",
        "Critical state variable modified without event emission. Makes off-chain monitoring impossible.",
        "Emit an event after updating critical state variables (owner, admin, implementation)."),
    "ETH-078a": ("MEDIUM", 0.7, "miscellaneous",
        "Sensitive private data stored on-chain. Private variables are still readable via storage slots.",
        "Never store secrets on-chain. Use commit-reveal or off-chain storage."),
    "ETH-078b": ("LOW", 0.5, "miscellaneous",
        "Private state variable (readable on-chain despite visibility).",
        "Do not rely on 'private' for data confidentiality. All on-chain data is public."),
    "ETH-078c": ("MEDIUM", 0.6, "miscellaneous",
        "Exposed NFT metadata / predictable URI. Attacker can snipe rare NFTs.",
        "Use commit-reveal pattern or encrypt metadata until minting completes."),
    "ETH-079": ("LOW", 0.8, "miscellaneous",
        ".transfer() and .send() forward only 2300 gas.",
        "Use .call{value: amount}('') with reentrancy guard instead."),
    "ETH-081": ("CRITICAL", 0.8, "transient-storage",
        "TSTORE uses hardcoded small slot ({}). Risk of collision.",
        "Use namespaced slots: bytes32 slot = keccak256('Contract.lock');"),
    "ETH-086": ("CRITICAL", 0.9, "access-control",
        "tx.origin == msg.sender no longer guarantees EOA after EIP-7702.",
        "Remove tx.origin == msg.sender check."),
    "ETH-089": ("HIGH", 0.7, "access-control",
        "extcodesize/isContract cannot reliably distinguish EOAs from contracts after EIP-7702.",
        "Do not rely on code size to determine account type."),
    "ETH-097": ("HIGH", 0.7, "miscellaneous",
        "Known compiler bug — dirty bytes (Solidity {}) .push() may include dirty data.",
        "Upgrade to Solidity >= 0.8.15 to fix dirty bytes issue."),
    "ETH-098a": ("HIGH", 0.6, "input-validation",
        "External/public function accepts parameters without input validation.",
        "Add require() checks for parameter bounds and zero address."),
    "ETH-098b": ("HIGH", 0.8, "input-validation",
        "msg.value checked in loop — same value passes every iteration. Allows multiple operations for single payment.",
        "Check total cost outside loop: require(msg.value >= price * amount)."),
}

# Name and word lists of single rules.
SENSITIVE_NAMES = ("withdraw|mint|burn|upgrade|setowner|setfee|setprice|setoracle|setsigner|pause|unpause|kill|"
                   "destroy|removeliquidity|removefee|addfee|addliquidity")
OWNER_SETTERS = "changeowner|setowner|transferownership|updateowner"
MODIFIER_WORDS = "only|auth|restricted|initializer|nonReentrant"
# ---------------------------------------------------------------------------

LINES_BEFORE = 20
LINES_AFTER = 23

# Blank space inside one line: look-around text holds many lines, and a pattern
# meant for one line must not run over its end.
_S = r"[^\S\n]"


def file_facts() -> dict[str, Column]:
    """Facts about a whole file, computed once per file from ``content``."""
    content, low = F.col("content"), F.lower(F.col("content"))
    minor = F.regexp_extract(content, r"pragma solidity\s*[\^>=<~]*\s*0\.(\d+)\.", 1)
    patch = F.regexp_extract(content, r"pragma solidity[^0-9]*0\.8\.(\d+)", 1)
    facts = {
        "f_minor": F.coalesce(F.when(minor != "", minor).try_cast("int"), F.lit(8)),
        "f_safe_erc20": low.contains("safetransfer(") | low.contains("safetransferfrom("),
        "f_guard": low.contains("nonreentrant") | low.contains("reentrancyguard"),
        "f_chain_id": low.contains("chainid"),
        "f_safe_math": low.contains("using safemath for"),
        "f_virtual_price": low.contains("get_virtual_price") & low.contains("remove_liquidity"),
        "f_assembly": low.contains("assembly"),
        "f_money": _any(low, "price", "rate", "ratio", "share", "reward", "precision", "debt"),
        "f_for": low.contains("for"),
        "f_lending": _any(low, "rate", "price", "borrow", "liquidat", "collateral", "value"),
        "f_pricing": _any(low, "price", "rate", "oracle", "getprice"),
        "f_implementation": low.contains("implementation"),
        "f_random": _any(low, "random", "seed", "lottery", "guess", "winner", "pick", "roll"),
        "f_swap": _any(low, "swap", "onswap", "pool", "amm"),
        "f_open_init": low.contains("function initialize") & ~low.contains("_disableinitializers"),
        "f_shares": _any(low, "deposit", "mint", "share", "convert"),
        "f_vault": _any(low, "deposit", "withdraw", "share", "vault"),
        "f_struct_map": low.contains("struct") & low.contains("mapping"),
        "f_nft": _any(low, "nft", "erc721", "mint", "tokenid"),
        "f_pragma": F.regexp_extract(content, r"pragma solidity[^0-9]*0\.8\.\d+", 0),
    }
    facts["f_dirty_bytes"] = ((facts["f_minor"] == 8) & content.contains(".push(") & low.contains("bytes")
                              & (patch != "") & (F.coalesce(patch.try_cast("int"), F.lit(2**31 - 1)) < 15))
    return facts


def _has(*words: str) -> Column:
    """The line holds one of the words."""
    return reduce(lambda a, b: a | b, [F.col("line").contains(w) for w in words])


def _rx(pattern: str) -> Column:
    return F.col("line").rlike(pattern)


def _any(text: Column, *words: str) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def _low(*words: str) -> Column:
    """The line holds one of the words, in letters of any case."""
    return _any(F.lower(F.col("line")), *words)


def _where(gate: Column, test: Column) -> Column:
    """A test that can hold only where the gate does.  Not an AND, of which both sides may be computed beforehand."""
    return F.when(gate, test)


def solidity_branches(text: Callable[[int, int], Column]) -> list[Branch]:
    """All branches in rule order.  ``text(lo, hi)`` joins the lines from ``lo``
    to ``hi`` relative to the anchor, clipped to the file; it is evaluated only
    where the anchor holds."""
    line = F.col("line")

    def ahead(n: int) -> Column:  # this line and the n-1 next ones
        return text(0, n - 1)

    def nxt(n: int) -> Column:
        return text(1, n)

    def prev(n: int) -> Column:
        return text(-n, -1)

    def around(b: int, a: int) -> Column:
        return text(-b, a - 1)

    fact = F.col
    # A word that every match of a pattern holds is looked for first, and a pattern starts with one character of a word
    # instead of the whole word: the same lines, at a fraction of the time.
    value_call = _has(".call{value:", ".call{ value:")
    name = F.regexp_extract(line, r"function\s+(\w+)", 1)
    params = F.regexp_extract(line, r"function\s+\w+\s*\(([^)]+)\)", 1)
    open_fn = _has("external", "public")
    zero_min = r"amountOut(?:Minimum|Min)\s*:\s*0\b"

    return [
        Branch("ETH-001", value_call, ~F.lower(prev(5)).contains("nonreentrant") & nxt(20).rlike(
            r"\w\[.*?\]\s*[-+*]?=\s|balance\w*\s*[-+]?=|\b(?:state|total|amount|counter|reserved)\w*\s*[-+]?="), once=True),
        Branch("ETH-004a", _has("receive()", "fallback()") & _has("external"),
               ahead(15).rlike(r"(?:target|vuln|victim)\w*\.\w+\(|get_virtual_price|getReward"), once=True),
        Branch("ETH-004b", _has("view") & _has("function") & open_fn & fact("f_virtual_price"), once=True),
        Branch("ETH-006", _where(_has("function") & open_fn, F.lower(name).rlike(SENSITIVE_NAMES) & ~_has(*MODIFIER_WORDS.split("|"))),
               nxt(6).rlike(r"\w\s*=\s*[^=]"), detail=name),
        Branch("ETH-007", _has("tx.origin") & _has("require", "if")),
        Branch("ETH-008", _has("selfdestruct", "suicide")),
        Branch("ETH-009", _where(_has("function") & _low(*OWNER_SETTERS.split("|")), F.lower(name).rlike(f"^(?:{OWNER_SETTERS})$") & ~_has("only", "auth"))),
        Branch("ETH-010", _where(_has("function") & _has("init") & open_fn, _rx(r"function\s+(?:init|initialize)\s*\(")),
               ~_any(ahead(3), "initializer", "initialized")),
        Branch("ETH-012", _has("sstore") & fact("f_assembly")),
        Branch("ETH-013a", _has("unchecked") & _has("{"), ahead(10).rlike(r"[+\-*]")),
        Branch("ETH-013b", _where((fact("f_minor") < 8) & ~fact("f_safe_math") & _has("=") & ~_has("function", "pragma", "import", "event"),
               _rx(r"[\w\]]\s*[-+*]=\s*\w|\w\s*=\s*\w+\s*[-+*]\s*\w"))),
        Branch("ETH-013c", _where(_has("uint") & _has("(") & ~_has("function", "event"), _rx(r"\buint(?:8|16|32|64|128)\s*\(")),
               detail=F.regexp_extract(line, r"\buint(8|16|32|64|128)\s*\(", 1)),
        Branch("ETH-014", _where(_has("/") & _has("*") & ~line.startswith("//") & ~line.startswith("/*"),
               _rx(r"[\w)]\s*/\s*[\w(]+[\w)]\s*\)\s*\*\s*\w|\w\s*/\s*\w+\s*\*\s*\w"))),
        Branch("ETH-017a", _where(_has("/") & _has("1e"), _rx(
            r"/\s*\(?\s*(?:\d+\s*(?:days|hours|minutes|seconds)\s*\*\s*1e\d+|1e\d{2,})")), once=True),
        Branch("ETH-017b", _where(fact("f_money") & _has("/") & _has(";") & ~_has("10"), _rx(r"\w\s*/\s*\w+\s*;")), once=True),
        Branch("ETH-018", _has(".call(", ".call{"), ~_any(ahead(4), "require", "success", "assert")),
        Branch("ETH-019", _has("delegatecall(")),
        Branch("ETH-021a", _has(".transfer(", ".send(") & fact("f_for"), once=True),
        Branch("ETH-021b", value_call, ahead(3).rlike(rf"require{_S}*\({_S}*\w+{_S}*,"), once=True),
        Branch("ETH-024a", _has("getReserves()") & fact("f_lending"), once=True),
        Branch("ETH-024b", _has("balanceOf(address(this))") & fact("f_pricing"), once=True),
        Branch("ETH-025", _where(_low("flash"), _rx(r"(?i)function\s+flashLoan|flashMint|flashBorrow"))),
        Branch("ETH-026", _low("swap", "exactinput"),
               ~(_any(around(5, 10), "deadline", "block.timestamp")
                 & _any(F.lower(around(5, 10)), "minamount", "amountoutmin", "slippage", "minreturn")), once=True),
        Branch("ETH-027", _where(_has("0") & _has("amountOutMin", "swap"), _rx(rf"amountOutMin.*:\s*0\b|{zero_min}|swap\w*\([^,]+,\s*0\s*,"))),
        Branch("ETH-028", _has("latestRoundData"), ~_any(ahead(12), "updatedAt", "answeredInRound"), once=True),
        Branch("ETH-029", _where(_has("storage") & ~_has("function", "pragma", "="), _rx(r"\bstorage\b"))),
        Branch("ETH-030a", _has("delegatecall") & fact("f_implementation"), once=True),
        Branch("ETH-030b", _where(_has("contract") & _has("Proxy", "Upgradeable"), _rx(r"contract\s+\w+\s+is\s+\w*(?:Proxy|Upgradeable)")),
               slot_variable_offset(nxt(14)) >= 0, once=True),
        Branch("ETH-030c", _where(_has("keccak256") & ~_has("constant"), _rx(
            r"bytes32\s+(?:internal|private)\s+\w*(?:SLOT|slot)\w*\s*=\s*keccak256")), once=True),
        Branch("ETH-032", _has("address(this).balance") & _has("==")),
        Branch("ETH-033a", _where((fact("f_minor") < 6) & _has("length"), _rx(r"\.\s*length\s*[-+]?="))),
        Branch("ETH-033b", _has("sstore") & fact("f_assembly")),
        Branch("ETH-034", _where(_has("==") & _has("balance", "upply"), _rx(
            r"(?:balance|totalSupply|supply)\w*\s*==\s*\d|require\s*\(.*balance\w*\s*==|"
            r"\.balanceOf\s*\([^)]*\)\s*==\s*\d|\.balance\s*==\s*\d"))),
        Branch("ETH-037", _has("block.timestamp", "block.prevrandao", "blockhash(") & fact("f_random")),
        Branch("ETH-038", _has("ecrecover"), ~_any(ahead(8), "address(0)", "!= 0", "!= address")),
        Branch("ETH-039", _has("ecrecover") & ~fact("f_chain_id"), once=True),
        Branch("ETH-041", _where(~fact("f_safe_erc20") & _has(".transfer(")
               & ~_has("safeTransfer", "msg.sender.transfer", "payable("), _rx(r"\.transfer\(\s*\w+.*,\s*\w"))),
        # eight lines from three before; near the head of a file still eight lines
        Branch("ETH-042", _has("transferFrom"),
               ~F.when(F.col("idx") == 0, text(0, 7)).when(F.col("idx") == 1, text(-1, 6))
               .when(F.col("idx") == 2, text(-2, 5)).otherwise(text(-3, 4)).contains("balanceOf"), once=True),
        Branch("ETH-044", _has("ERC777", "tokensReceived", "tokensToSend") & ~fact("f_guard")),
        Branch("ETH-045", _where(_has("address") & open_fn & _has("function"), _rx(
            r"function\s+\w*(?:set|update|change|transfer)\w*(?:Owner|Admin|Manager|Address)\w*\s*\(")),
               ~(ahead(5).contains("address(0)") & ahead(5).rlike(r"address\(0\).*(?:!=|require)|(?:!=|require).*address\(0\)"))),
        Branch("ETH-046", _has(".approve(") & ~_has("safeApprove"), once=True),
        Branch("ETH-047", _has("type(uint256).max") & _has("approve")),
        Branch("ETH-048a", _has("_mint("), ~_any(around(3, 1), "only", "auth", "require")),
        Branch("ETH-048b", _where(_has("onSwap") | (fact("f_swap") & _low("reserve")), _rx(r"function\s+onSwap\b")
               | (_rx(r"(?i)reserves?\w*\s*(?:TokenIn|TokenOut|In|Out)") & fact("f_swap"))), once=True),
        Branch("ETH-049", (_has("Initializable") | (_has("initializer") & ~_has("modifier"))) & fact("f_open_init"),
               once=True),
        Branch("ETH-055", _where(_has("unction") & _low("propose", "vote", "execute"), _rx(r"(?i)function\s+\w*(?:propose|vote|execute)\w*\s*\(")),
               ~(_any(F.lower(around(20, 20)), "snapshot", "checkpoint", "getpastvotes", "getpriorvotes")
                 & around(20, 20).rlike("(?i)snapshot|checkpoint|getPastVotes|getPriorVotes")), once=True),
        Branch("ETH-057a", _where(fact("f_shares") & _has("==") & _has("total"), _rx(
            r"totalSupply\s*(?:\(\s*\))?\s*==\s*0|totalShares\s*==\s*0|total\w*\.(?:amount|assets?)\s*==\s*0")), once=True),
        Branch("ETH-057b", _where(fact("f_vault") & _has("totalSupply") & _has("balanceOf"), _rx(
            r"totalSupply\s*[/*].*balanceOf|balanceOf.*[/*].*totalSupply")), once=True),
        Branch("ETH-060a", _where(_has("deadline"), _rx(r"deadline\s*:\s*block\.timestamp\b") | _has("type(uint256).max"))),
        Branch("ETH-060b", _where(_has("amountOutMin"), _rx(zero_min))),
        Branch("ETH-064", _where(_has("function") & _has("onERC721Received", "onERC1155Received", "onFlashLoan", "uniswapV", "pancakeCall"), _rx(
            r"function\s+(?:onERC721Received|onERC1155Received|onFlashLoan|uniswapV\dCall|pancakeCall)")),
               ~(ahead(8).contains("msg.sender") & ahead(8).rlike(r"msg\.sender.*(?:require|==|if)|(?:require|==|if).*msg\.sender"))),
        Branch("ETH-065", _where(_low("function") & _low("protocol", "target", "router", "pool"), _rx(
            r"(?i)function\s+\w+\s*\([^)]*(?:Protocol|address)\s+\w*(?:protocol|target|router|pool)")), once=True),
        Branch("ETH-066", _where(_has(".length") & _has("for"), _rx(r"\bfor\b"))),
        Branch("ETH-071", _has("pragma solidity ^", "pragma solidity >="), once=True),
        Branch("ETH-072", _where(_has("pragma solidity "), _has(*(f"pragma solidity {c}0.{v}." for v in (4, 5, 6, 7) for c in ("", "^"))))),
        Branch("ETH-073", _has("abi.encodePacked") & _has(",")),
        Branch("ETH-075a", _where(_has("delete") & ~_has("mapping"), _rx(r"\bdelete\s+\w+\["))),
        Branch("ETH-075b", _where(fact("f_struct_map") & _has("delete"), _rx(r"\bdelete\s+\w+\s*;"))),
        Branch("ETH-075c", _where(_has(".length") & _has("for"), _rx(r"for\s*\(\s*\w+\s+\w+\s*=\s*0\s*;\s*\w+\s*<\s*\w+\.length")),
               bypassable_loop(ahead(LINES_AFTER + 1))),
        Branch("ETH-075d", _has("return;"), _where(prev(15).contains("for"), F.regexp_count(
            prev(15), F.lit(rf"(?:^|\n)[^\n]*?for{_S}*\(")) >= 2)),
        Branch("ETH-076", _where(_has("=") & _has("owner", "admin", "paused", "implementation") & ~_has("function", "constructor", "event"),
               _rx(r"\b(?:owner|admin|paused|implementation)\s*=")), ~ahead(4).contains("emit "), once=True),
        Branch("ETH-078a", _where(_has("private"), _rx(r"\bprivate\b"))),
        Branch("ETH-078b", _where(_has("private"), _rx(r"^\s+(?:uint|int|address|bytes|string|bool)\s+private\s+\w")), once=True),
        Branch("ETH-078c", _where(fact("f_nft") & _low("ipfs", "dweb", "metadata", "tokenuri", "baseuri"),
                                  _rx("(?i)ipfs|dweb|metadata|tokenURI|baseURI")), once=True),
        Branch("ETH-079", _has(".transfer(", ".send(")),
        Branch("ETH-081", _where(_has("tstore"), _rx(r"tstore\s*\(\s*(?:0x[0-9a-fA-F]{1,4}|[0-9]{1,3})\s*,")),
               detail=F.regexp_extract(line, r"tstore\s*\(\s*(0x[0-9a-fA-F]{1,4}|[0-9]{1,3})\s*,", 1)),
        Branch("ETH-086", _has("tx.origin") & _has("msg.sender") & _has("==", "require")),
        Branch("ETH-089", _has("extcodesize", "isContract")),
        Branch("ETH-097", fact("f_dirty_bytes"), detail=fact("f_pragma")),
        Branch("ETH-098a", _where(_has("function") & open_fn & ~_has("internal", "private"), _any(params, "int", "address")),
               ~_any(ahead(6), "require(", "revert", "if (")),
        Branch("ETH-098b", _where(_has("msg.value") & _has("require"), _rx(r"require\s*\(\s*msg\.value\s*>=")),
               prev(10).rlike(rf"for{_S}*\(")),
    ]


def slot_variable_offset(following: Column) -> Column:
    """Index (0-based) of the first plain state variable among the following
    lines, before any function, constructor or event; -1 when there is none."""
    head = F.regexp_replace(following, rf"(?s)(?:^|\n){_S}*(?:function|constructor|event).*", "")
    code = F.regexp_replace(head, r"//[^\n]*", "")
    plain = F.regexp_replace(code, r"(?m)^[^\n]*(?:constant|immutable|(?i:_slot))[^\n]*$", "")
    pos = F.regexp_instr(plain, F.lit(
        rf"(?m)^{_S}+(?:address|uint256|bytes32|bool){_S}+(?:private|internal){_S}+\w"))
    told = _any(following, "private", "internal")
    return F.when(told, F.when(pos > 0, F.regexp_count(F.substring(plain, F.lit(1), pos - 1), F.lit("\n"))).otherwise(F.lit(-1))).otherwise(F.lit(-1))


def displaced_snippet(following: Column, offset: Column) -> Column:
    return trimmed(F.split_part(following, F.lit("\n"), F.greatest(offset, F.lit(0)) + 1))


def _count(text: Column, char: str) -> Column:
    """How often ``char`` stands in the text; without a pattern, whose matches would all be listed first."""
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def bypassable_loop(block: Column) -> Column:
    """The loop opened on the first line checks something inside, closes within
    20 lines, and value moves in the five lines from its end."""
    zero = F.struct(F.lit(0).alias("depth"), F.lit(-1).alias("end"), F.lit(False).alias("checks"),
                    F.lit(False).alias("moves"), F.lit(0).alias("i"))

    def step(s: Column, text: Column) -> Column:
        open_ = (s["end"] < 0) & (s["i"] < 20)
        depth = s["depth"] + F.when(open_, _count(text, "{") - _count(text, "}")).otherwise(0)
        end = F.when(open_ & (depth <= 0) & (s["i"] > 0), s["i"]).otherwise(s["end"])
        checks = s["checks"] | (open_ & text.rlike("(?i)verify|require|ecrecover"))
        moves = s["moves"] | ((end > 0) & (s["i"] < end + 5)
                              & (text.contains(".transfer(") | text.contains(".call{") | text.contains(".send(")))
        return F.struct(depth.alias("depth"), end.alias("end"), checks.alias("checks"), moves.alias("moves"),
                        (s["i"] + 1).alias("i"))

    return F.aggregate(F.split(block, "\n", -1), zero, step, lambda s: (s["end"] > 0) & s["checks"] & s["moves"])
