"""Fixed values that must equal the reference behaviour, kept together.

FIXED VALUES (do not edit without re-checking parity):
- WHITESPACE_CODEPOINTS: the code points Python's ``str.strip()`` removes
  (``str.isspace``), used for the strip in text composition and label parsing.
- NA_TOKENS: pandas' default ``read_csv`` NA strings; a cell equal to one of
  them (after no trimming) becomes missing. ``" "`` and ``"none"`` are not in it.
- The rest are the pipeline's defaults: 20% validation, seed 42, windows of
  128 tokens, 100-row pages, top-10 labels, 20 histogram bins, scoring batch 32.
"""

WHITESPACE_CODEPOINTS = (
    [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0, 0x1680]
    + list(range(0x2000, 0x200B))
    + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
WHITESPACE = "".join(chr(c) for c in WHITESPACE_CODEPOINTS)

NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)

DATASETS = ("indomain", "ood_a", "ood_b")

SEED = 42
VAL_FRACTION = 0.2
MAX_TOKENS = 128
PAD_TOKEN = "[PAD]"
PAGE_SIZE = 100
TOP_K = 10
TOP_STATS = 6
PREVIEW_ROWS = 10
HIST_BINS = 20
SCORE_BATCH = 32
NB_ALPHA = 1.0

# Word tokens: maximal runs of Unicode letters or digits after lower-casing.
TOKEN_PATTERN = r"[\p{L}\p{N}]+"

# Literals of a label cell (whole-string patterns: a prefix match would wrongly accept
# "[1,2" or "[2,a]").
_SP = r"[ \t\f\r\n]*"
_DIGITS = r"[0-9](?:_?[0-9])*"
_INT = r"[+-]?(?:[1-9](?:_?[0-9])*|0(?:_?0)*)"
_DECIMAL = (r"[+-]?(?:(?:" + _DIGITS + r")\.(?:" + _DIGITS + r")?(?:[eE][+-]?" + _DIGITS + r")?"
            r"|\." + _DIGITS + r"(?:[eE][+-]?" + _DIGITS + r")?|" + _DIGITS + r"[eE][+-]?" + _DIGITS + ")")
_RADIX = r"[+-]?0[xXoObB](?:_?[0-9a-fA-F])+"
_QUOTED = r"(?:'[^'\\\n]*'|\"[^\"\\\n]*\")"
_ATOM = "(?:" + "|".join((_RADIX, _DECIMAL, _INT, "True", "False", "None", _QUOTED)) + ")"
_NESTED = (r"(?:[\[(]" + _SP + "(?:" + _ATOM + _SP + "(?:," + _SP + _ATOM + _SP + ")*,?" + _SP + r")?[\])])")
_ITEM = "(?:" + _ATOM + "|" + _NESTED + ")"
LIST_LABEL_PATTERN = (
    r"^\[" + _SP + "(" + _ITEM + ")" + _SP + "(?:," + _SP + _ITEM + _SP + ")*,?" + _SP + r"\]$"
)
EMPTY_LIST_PATTERN = r"^\[" + _SP + r"\]$"
SCALAR_LABEL_PATTERN = r"^[+-]?[0-9](?:_?[0-9])*$"
ATOM_PATTERN = "^" + _ATOM + "$"
DECIMAL_PATTERN = "^" + _DECIMAL + "$"
RADIX_PATTERN = r"^([+-]?)0([xXoObB])((?:[0-9a-fA-F])+)$"
QUOTED_INTEGER_PATTERN = r"^(?:'\s*[+-]?[0-9](?:_?[0-9])*\s*'|\"\s*[+-]?[0-9](?:_?[0-9])*\s*\")$"
# A comment after a cell without quotes, or after its last quote.
COMMENT_PATTERN = r"(?<=[^#'\"])" + _SP + r"#[^'\"\n]*$"
