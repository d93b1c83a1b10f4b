"""SQL snippets (DuckDB dialect) used by the oracle queries.

These restate the scoring rules independently of the Spark code so the
correctness check compares two separate formulations.
"""

# The oracle's own grammars, written from the rule: whole text, digits of any
# script, single underscores between digits, white space at both ends.
_SP = "[\\t-\\r\\x1c-\\x1f \\x85\\xa0]*"
# Scripts whose digits the fixtures use.
_SCRIPTS = "".join(chr(zero + i) for zero in (0x660, 0x966) for i in range(10))
INT_PATTERN = f"^{_SP}[-+]?\\d+(_\\d+)*{_SP}$".replace("\\d", "\\p{Nd}")
FLOAT_PATTERN = (f"^{_SP}[-+]?((\\d+(_\\d+)*)(\\.(\\d+(_\\d+)*)?)?|\\.\\d+(_\\d+)*)([eE][-+]?\\d+(_\\d+)*)?{_SP}$"
                 f"|^{_SP}[-+]?([iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN]){_SP}$").replace("\\d", "\\p{Nd}")
LIST_PATTERN = "^[ \\t]*\\[[ ]*([-0-9.eE+]+([ ]*,[ ]*[-0-9.eE+]+)*)?[ ]*\\][ ]*$"
from evalspark.functions.text import PY_WHITESPACE, PY_WHITESPACE_CHARS, VERDICT_STRIP_CHARS

WS = PY_WHITESPACE


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def tokens(v: str) -> str:
    spaces = " " * len(VERDICT_STRIP_CHARS)
    return (f"string_split(trim(regexp_replace(translate(lower({v}), {q(VERDICT_STRIP_CHARS)}, {q(spaces)}), "
            f"{q(WS + '+')}, ' ', 'g')), ' ')")


def token_sign(v: str, a: str) -> str:
    return f"CAST(coalesce(list_contains({tokens(v)}, lower({a})), false) AS INTEGER)"


def contains_sign(v: str, a: str) -> str:
    return f"CAST(coalesce(contains(lower({v}), {a}), false) AS INTEGER)"


WS_CHARS_SQL = "(" + " || ".join(f"chr({ord(c)})" for c in PY_WHITESPACE_CHARS) + ")"


def py_strip(x: str) -> str:
    return f"trim({x}, {WS_CHARS_SQL})"


def says_yes(x: str) -> str:
    return f"CAST(coalesce(contains(lower({x}), 'yes'), false) AS INTEGER)"


def ternary(x: str, strip_dots: bool = False) -> str:
    y = f"lower({x})"
    if strip_dots:
        y = f"regexp_replace({y}, '^\\.+|\\.+$', '', 'g')"
    return f"(CASE {y} WHEN 'yes' THEN 1 WHEN 'no' THEN 0 WHEN 'unclear' THEN -1 END)"


def ratio(num: str, den: str, zero: str | None = None) -> str:
    r = f"CAST({num} AS DOUBLE) / NULLIF(CAST({den} AS DOUBLE), 0)"
    return f"coalesce({r}, {zero})" if zero is not None else r


def _re(p: str) -> str:
    # Java's (?s) and DuckDB's 's' option mean the same; strip the inline flag.
    return q(p.replace("(?s)", ""))


def numeric_sign(v: str, a: str) -> str:
    """S4 with the same grammar guards as the Spark fast path (number lists only)."""
    def plain(x: str) -> str:
        return f"translate(replace({py_strip(x)}, '_', ''), '{_SCRIPTS}', '{'0123456789' * 2}')"

    def whole(x: str) -> str:  # sign and digits, without leading zeros; no sign at zero
        digits = f"regexp_replace({plain(x)}, '^[-+]?0*', '')"
        return f"CASE WHEN {digits} <> '' THEN concat(CASE WHEN {plain(x)} LIKE '-%' THEN '-' ELSE '' END, {digits}) ELSE '0' END"

    vi, ai = whole(v), whole(a)
    vd = f"TRY_CAST({plain(v)} AS DOUBLE)"
    ad = f"TRY_CAST({plain(a)} AS DOUBLE)"
    vl = f"TRY_CAST({v} AS DOUBLE[])"
    al = f"TRY_CAST({a} AS DOUBLE[])"
    return f"""(CASE WHEN {a} IS NULL OR {v} IS NULL THEN 0
      WHEN regexp_matches({a}, {_re(INT_PATTERN)}) THEN
        CASE WHEN regexp_matches({v}, {_re(INT_PATTERN)}) AND {vi} = {ai} THEN 1 ELSE 0 END
      WHEN regexp_matches({a}, {_re(FLOAT_PATTERN)}) THEN
        CASE WHEN regexp_matches({v}, {_re(FLOAT_PATTERN)}) AND {vd} = {ad} AND NOT isnan({ad}) THEN 1 ELSE 0 END
      WHEN regexp_matches({a}, {_re(LIST_PATTERN)}, 's') AND {al} IS NOT NULL THEN
        CASE WHEN regexp_matches({v}, {_re(LIST_PATTERN)}, 's') AND {vl} = {al} THEN 1 ELSE 0 END
      ELSE 0 END)"""


def unpivot(src: str, by: str, cols: list[str], group: str) -> str:
    """Wide -> long (keeps nulls) as UNION ALL of one select per metric."""
    lead = f"{by}, " if by else ""
    return "\n    UNION ALL ".join(
        f"SELECT {lead}{q(group)} AS metric_group, {q(c)} AS metric, CAST({c} AS DOUBLE) AS value FROM {src}"
        for c in cols)


# Fixed values mirrored from evalspark.functions.chains for the oracle side.
def parse_steps(t: str) -> str:
    """S15 in DuckDB: marker -> drop to first ':' and delete colons; strip; split; drop blank."""
    body = (f"(CASE WHEN contains(lower({t}), 'reasoning steps') OR contains(lower({t}), 'step-by-step reasoning') "
            f"THEN replace(regexp_extract({t}, '^[^:]*:(.*)$', 1, 's'), ':', '') ELSE {t} END)")
    lines = f"string_split({py_strip(body)}, chr(10))"
    kept = f"list_filter({lines}, lambda x: NOT regexp_matches(x, {q('^' + WS + '*$')}))"
    return f"(CASE WHEN len({kept}) > 0 THEN {kept} END)"


def refusal(t: str, phrases, fallback: str) -> str:
    cond = " OR ".join(f"contains({t}, {q(p)})" for p in phrases)
    return f"(CASE WHEN coalesce({cond}, false) THEN {q(fallback)} ELSE {t} END)"


def context_prompt(chain: str, header: str) -> str:
    body = (f"array_to_string(list_transform({chain}[1:len({chain}) - 1], "
            f"lambda x, i: concat(CAST(i AS VARCHAR), '. ', x, chr(10))), '')")
    return f"(CASE WHEN len({chain}) > 0 THEN concat({q(header)}, {body}) END)"


def last_instruction(chain: str, prefix: str) -> str:
    return f"(CASE WHEN len({chain}) > 0 THEN concat({q(prefix)}, {chain}[-1]) END)"


def fill(template: str, **values: str) -> str:
    """Template with {name} slots -> concat of literals and expressions (nulls -> '')."""
    import re
    parts = re.split(r"\{(\w+)\}", template)
    pieces = []
    for i, p in enumerate(parts):
        if i % 2 == 0:
            if p:
                pieces.append(q(p))
        else:
            pieces.append(f"coalesce(CAST({values[p]} AS VARCHAR), '')")
    return f"concat({', '.join(pieces)})"
