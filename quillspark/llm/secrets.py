"""Secret scans: fixed patterns, and a battery of randomness tests with false-discovery control.

Candidates are runs of 20 or more characters of the base64 alphabets. For each, the encoding is
inferred (hex, base32, one case with digits, base64; the first three in either case) and four tests
ask whether it is anything but text-like or patterned, each against its own kind of such strings:

* uniformity: the chi-squared statistic over the encoding's alphabet lies below what strings of a
  few symbols only would give;
* letters: rare letters are more frequent than in words (mean and variance of the letters'
  surprise are those of words; digits and signs don't count). Hex has too few letters for it;
* runs: lower case, upper case, digits and signs alternate more often than in text-like names of
  the encoding: seldom where there is one case, often in names of mixed case or with signs;
* serial correlation: neighbouring symbols are less correlated than in alphabetic sequences.

Plain numbers and UUIDs are names, not secrets, and never discoveries. Each test gives a bound
exp(-z*z/2)/2 on the probability of so small a departure from random under its hypothesis; a
candidate must pass all, so the largest counts (intersection-union).
These values of the distinct candidates are counted over the whole corpus in length classes on a fixed grid, rounded up, and
in each class the Benjamini-Hochberg rule at level ``FALSE_SHARE`` sets the cutoff. So the share of false
discoveries is controlled at every length, and short strings need the stronger evidence.

Everything is DataFrame and SQL functions. Defined cases: null counts as empty; rows that share a
doc_id are scanned each for itself; an empty table gives an empty result; all columns are kept
and columns with the names of results are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, stored, table
from .matches import found, quoted

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
KINDS = ("assign", "access", "hex", "random")
FALSE_SHARE = 0.01
#: Upper ends of the length classes.
CLASSES = (31, 47, 63, 127)
#: Cells of the grid a factor of ten in probability has.
GRID = 20
#: The kind of string a secret is told from, by alphabet size. They are chosen, not estimated, as a
#: corpus's own runs hold secrets too: a string that uses no more than this many symbols evenly, the
#: hypothesis of the chi-squared test (names of a few words use 6 to 8, hexadecimal names 4);
SYMBOLS = {16: 4, 32: 16 / 3, 36: 6, 64: 8}
#: so the sum of squared frequencies exceeds that of even use, times the alphabet, by this;
EXCESS = {k: k / m - 1 for k, m in SYMBOLS.items()}
#: the variance of a symbol's frequency under its own distribution, sum p^3 - (sum p^2)^2 (0.001 for the
#: letters of English, more where there are fewer symbols);
SPREAD = {16: 0.004, 32: 0.003, 36: 0.003, 64: 0.0012}
#: the share of neighbours of two classes (lower, upper, digit, sign): in names of one case there is
#: a number now and then, in others a capital or a sign at every fourth character;
CHANGES = {16: 0.12, 32: 0.05, 36: 0.05, 64: 0.25}
#: and the serial correlation of alphabetic sequences.
SERIAL = 0.8
ALPHABETS = {16: "0123456789abcdef", 32: "abcdefghijklmnopqrstuvwxyz234567", 36: "abcdefghijklmnopqrstuvwxyz0123456789", 64: "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
#: Thousandths of the letters a to z in words of European languages.
LETTERS = (75, 15, 26, 40, 145, 15, 20, 55, 73, 3, 8, 40, 25, 85, 63, 22, 4, 68, 63, 85, 38, 12, 14, 4, 12, 5)
#: How much more the letters of a word vary than independent ones.
UNEVEN = 1.5
_SHARES = [x / sum(LETTERS) for x in LETTERS]
_MEAN = -sum(p * math.log(p) for p in _SHARES)
#: Surprise of no letter and of a to z, above the mean of words.
SURPRISE = [0.0, *(round(-math.log(p) - _MEAN, 6) for p in _SHARES)]
SURPRISE_VARIANCE = UNEVEN * sum(p * (math.log(p) + _MEAN) ** 2 for p in _SHARES)
UUID = "^[0-9a-fA-F]{8}([+/][0-9a-fA-F]{4}){3}[+/][0-9a-fA-F]{12}$"
_EMPTY = "cast(array() as array<struct<start:int,stop:int>>)"


def _by_size(values: dict, size: str = "x.k") -> str:
    show = lambda v: f"'{v}'" if isinstance(v, str) else f"{v}D"
    return f"case {size} " + " ".join(f"when {k} then {show(v)}" for k, v in values.items()) + " end"


def _tested(runs: str) -> str:
    """SQL: the candidates with their length, a hash and the cell of their probability bound, step
    by step; each step is linear in the length of a candidate."""
    clean = r"translate(regexp_replace(x.g0, '=+$', ''), '-_', '+/')"
    surprise = "array(" + ", ".join(f"{v}D" for v in SURPRISE) + ")"
    steps = [
        f"named_struct('start', x.start, 'stop', x.stop, 's', {clean})",
        f"named_struct('start', x.start, 'stop', x.stop, 's', x.s, 'h', xxhash64(x.s), 'k', case when x.s rlike '^[0-9]+$' or x.s rlike '{UUID}' then 0 when x.s rlike '^([0-9a-f]+|[0-9A-F]+)$' then 16 when x.s rlike '^([A-Z2-7]+|[a-z2-7]+)$' then 32 when x.s rlike '^([A-Z0-9]+|[a-z0-9]+)$' then 36 else 64 end)",
        "named_struct('start', x.start, 'stop', x.stop, 'h', x.h, 's', if(x.k < 64, lower(x.s), x.s), 'k', x.k)",
        f"named_struct('start', x.start, 'stop', x.stop, 'h', x.h, 'k', x.k, 'n', char_length(x.s), 'c', split(x.s, ''), 's', x.s, 'a', {_by_size(ALPHABETS)})",
        # squared counts: one pass a letter of the alphabet
        f"""named_struct('start', x.start, 'stop', x.stop, 'h', x.h, 'k', x.k, 'n', x.n,
            'squares', aggregate(transform(split(x.a, ''), a -> cast(x.n - char_length(replace(x.s, a, '')) as double)), 0D, (t, n) -> t + n * n),
            'kind', transform(x.c, c -> case when c between 'a' and 'z' then 1 when c between 'A' and 'Z' then 2 when c between '0' and '9' then 3 else 4 end),
            'surprise', transform(x.c, c -> {surprise}[instr('abcdefghijklmnopqrstuvwxyz', lower(c))]),
            'letters', char_length(regexp_replace(x.s, '[^A-Za-z]', '')),
            'v', transform(x.c, c -> instr(x.a, c)))""",
        """named_struct('start', x.start, 'stop', x.stop, 'h', x.h, 'k', x.k, 'n', x.n, 'squares', x.squares, 'v', x.v, 'letters', x.letters,
            'surprise', aggregate(x.surprise, 0D, (t, s) -> t + s),
            'changes', aggregate(sequence(1, x.n - 1), 0, (t, i) -> t + if(x.kind[i] <> x.kind[i - 1], 1, 0)),
            'mean', aggregate(x.v, 0D, (t, v) -> t + v) / x.n)""",
        """named_struct('start', x.start, 'stop', x.stop, 'h', x.h, 'k', x.k, 'n', x.n, 'squares', x.squares, 'changes', x.changes, 'surprise', x.surprise, 'letters', x.letters,
            'top', aggregate(sequence(1, x.n - 1), 0D, (t, i) -> t + (x.v[i] - x.mean) * (x.v[i - 1] - x.mean)),
            'all', aggregate(x.v, 0D, (t, v) -> t + (v - x.mean) * (v - x.mean)))""",
        f"""named_struct('start', x.start, 'stop', x.stop, 'h', x.h, 'k', x.k, 'n', x.n,
            'z', least((x.k - 1 + (x.n - 1) * {_by_size(EXCESS)} - (x.k * x.squares / x.n - x.n)) / sqrt(2D * (x.k - 1) + 4D * x.n * x.k * x.k * {_by_size(SPREAD)}),
                if(x.k = 16, double('infinity'), x.surprise / sqrt({SURPRISE_VARIANCE}D * greatest(x.letters, 1))),
                (x.changes / (x.n - 1) - {_by_size(CHANGES)}) / sqrt({_by_size({k: c * (1 - c) for k, c in CHANGES.items()})} / (x.n - 1)),
                ({SERIAL}D - if(x.all > 0, x.top / x.all, 1D)) * sqrt(x.n / {1 - SERIAL**2}D)))""",
        # the cell of the bound's logarithm, towards the weaker evidence
        f"named_struct('start', x.start, 'stop', x.stop, 'n', x.n, 'cell', if(x.k > 0 and x.z > 0, int(floor({GRID}D * (x.z * x.z / 2 * {0.4342944819032518}D + {0.3010299956639812}D))), 0), 'h', x.h)",
    ]
    out = runs
    for step in steps:
        out = f"transform({out}, x -> {step})"
    return out


def _class(n: str) -> str:
    return "case " + " ".join(f"when {n} <= {top} then {i}" for i, top in enumerate(CLASSES)) + f" else {len(CLASSES)} end"


def _marked(docs: DataFrame, text: str, assign: str, access: str, hex_: str, random: str) -> DataFrame:
    """Add the base spans of each kind, and the tested candidates that no base span overlaps."""
    low, runs = f"lower(`{text}`)", fresh(docs, "runs")[0]
    t = f"`{text}`"
    named = " or ".join(f"contains({low}, '{w}')" for w in ("password", "passwd", "secret", "token", "apikey", "api_key"))
    plain = lambda spans: f"transform({spans}, x -> named_struct('start', x.start, 'stop', x.stop))"
    out = docs.withColumn(assign, F.expr(f"if({named}, {plain(f'filter({found(t, ASSIGN, 2)}, x -> char_length(x.g2) >= 8)')}, {_EMPTY})"))
    out = out.withColumn(access, F.expr(f"if(contains({t}, 'AKIA'), {found(t, ACCESS)}, {_EMPTY})"))
    out = out.withColumn(runs, F.expr(f"{t} rlike {quoted(RUN)}"))
    out = out.withColumn(hex_, F.expr(f"if({t} rlike '{HEX}', {found(t, HEX)}, {_EMPTY})"))
    free = " and ".join(f"not exists({c}, b -> b.start < x.stop and x.start < b.stop)" for c in (assign, access, hex_))
    none = "cast(array() as array<struct<start:int,stop:int,n:int,cell:int,h:bigint>>)"
    return out.withColumn(random, F.expr(f"if({runs}, {_tested(f'filter({found(t, RUN, 0)}, x -> {free} and char_length(rtrim(\"=\", x.g0)) >= 20)')}, {none})")).drop(runs)


def cutoffs(candidates: DataFrame) -> dict[int, int]:
    """For each length class the least cell that is a discovery, from (n, cell, h) of all
    candidates. A string counts once, however many documents have it: its copies are one test."""
    once = candidates.select(F.expr(_class("n")).alias("c"), "cell", "h").distinct()
    cells = once.groupBy("c", "cell").count().collect()  # a grid
    out = {}
    for c in {r.c for r in cells}:
        mine = sorted(((r.cell, r["count"]) for r in cells if r.c == c), reverse=True)
        total, seen = sum(n for _, n in mine), 0
        for cell, n in mine:
            seen += n
            if cell and 10.0 ** (-cell / GRID) <= FALSE_SHARE * seen / total:
                out[c] = cell
    return out


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``secrets``: array of (start, rank, kind, stop), ordered; base spans and discoveries.

    The texts are searched once: what is found is stored beside the columns to ``keep`` (all, if
    not given), for the cutoffs and for the result.
    """
    plain = docs.drop("secrets")
    whole, assign, access, hex_, random = fresh(plain, "whole", "assign", "access", "hex", "random")
    marked = _marked(plain.withColumn(whole, F.coalesce(F.col(text), F.lit(""))), whole, assign, access, hex_, random)
    kept = [c for c in plain.columns if keep is None or c in keep]
    marked, _ = stored(marked.select(*kept, assign, access, hex_, random), "marked")
    cut = cutoffs(marked.select(F.explode(random).alias("x")).select("x.*"))
    passes = " or ".join(f"({_class('x.n')} = {c} and x.cell >= {cell})" for c, cell in sorted(cut.items())) or "false"
    span = lambda i, column: f"transform({column}, x -> named_struct('start', x.start, 'rank', {i}, 'kind', '{KINDS[i]}', 'stop', x.stop))"
    spans = ", ".join([span(0, assign), span(1, access), span(2, hex_), span(3, f"filter({random}, x -> {passes})")])
    return marked.withColumn("secrets", F.expr(f"array_sort(concat({spans}))")).select(*kept, "secrets")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Replace each secret in the text by a mark; spans that overlap become one. ``n_chars``, if
    there is one, follows the new text. All rows and columns stay, also one named ``secrets``."""
    names = docs.columns
    mine = next((c for c in names if c.lower() == "secrets"), None)
    old, spans, given = fresh(docs, "old", "spans", "given")
    plain = docs.withColumnRenamed(mine, given) if mine else docs
    out = scan(plain, text).withColumnRenamed("secrets", spans).withColumnRenamed(text, old)
    # the parts of the text before each span that starts beyond all earlier spans
    build = f"""concat_ws('', aggregate({spans}, named_struct('at', 0, 'out', cast(array() as array<string>)), (s, x) -> named_struct('at', greatest(s.at, x.stop),
        'out', if(x.start >= s.at, array_append(array_append(s.out, substring({old}, s.at + 1, x.start - s.at)), {quoted(mark)}), s.out)), s -> array_append(s.out, substring({old}, s.at + 1))))"""
    out = out.withColumn(text, F.when(F.size(spans) > 0, F.expr(build)).otherwise(F.col(old)))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.char_length(text).cast("long")).otherwise(F.col("n_chars")))
    return out.select(*[F.col(given).alias(c) if c == mine else c for c in names])


def query(spark, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    shown = lambda spans: f"array_join(transform({spans}, x -> concat_ws(':', x.kind, x.start, x.stop)), ',')"
    count = lambda kind: F.expr(f"cast(size(filter(secrets, x -> x.kind = '{kind}')) as bigint)").alias(f"n_{kind}")
    base = "filter(secrets, x -> x.rank < 3)"
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(F.expr(shown(base)), 256).alias("base_sha256"), F.expr(shown("secrets")).alias("spans"))
