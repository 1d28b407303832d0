"""Secret scans: known shapes, and a battery of randomness tests.

Known shapes are the three base patterns. Beyond them, every long run of token characters
outside their spans is a candidate, if it has a digit, mixes cases or is letters of one case.
An ``=`` ends a run, so a name, its value and end padding are apart; a run with separators of
both base64 alphabets is cut at the ones, at the others and at all of them, and every long part
is a candidate. Its encoding is inferred from its characters (the smallest alphabet that holds
it), and its symbol values are tested for uniform use of the encoding's alphabet (chi-squared),
for runs above and below the middle, and for serial correlation; Fisher's method joins the
three into one score, high for random strings.

Long and short strings are not alike, nor are alphabets, so the threshold is set for each
length band of each encoding: every candidate brings a control, letters of the plain words next
to it that its own alphabet holds, cut to its length and put through the same tests over that
alphabet. In each band the lowest score, from ``LEAST`` on, is taken at which controls are at
most ``max_false`` of the candidates. Candidates without a digit before a letter, as names written together, have bands
of their own, and their controls the same capitals, as such names pass the tests more often.
Where the text beside has too few letters, a fixed passage gives the control. That table is of
bounded size (encodings by bands by score steps), counted over all documents and combined before
the shuffle.

Defined results: a null text is empty and has no spans; repeated rows get equal spans;
added spans never overlap base ones; overlapping base spans of different kinds all stay, and
so do overlapping parts of one run.
Result columns replace columns of the same names.
"""

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.llm import scratch
from jobtide.llm.columns import numbered, restored

# The base patterns.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

KINDS = ["assign", "access", "hex", "random"]
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}")
CLASHING = [re.compile(r"[^_-]{20,}"), re.compile(r"[^+/]{20,}"), re.compile(r"[^+/_-]{20,}")]
BANDS = [20, 24, 32, 48, 80, 160]
STEPS = 200
# Random strings score lower in one of a hundred cases, names and paths in nearly all.
LEAST = 0.01
# Names written together seldom have it; of random base62 strings of 20 characters 96 % do.
STRAY = re.compile(r"[0-9][A-Za-z]")
TOKEN_END = re.compile(r"^[A-Za-z0-9+/_-]+")
TOKEN_START = re.compile(r"[A-Za-z0-9+/_-]+$")
PASSAGE = (
    "A young clerk in the harbour office kept a small book in which every ship that came in was "
    "written down with its cargo and the names of its crew. When the wind turned in the evening "
    "the boats lay close beside each other, and from the windows above the market one could see "
    "how the lamps were lit along the quay. Nobody asked what became of the old lists, but the "
    "clerk had put them into a wooden box under the stairs, where they stayed dry for many years. "
    "Later a teacher found them there and read aloud to the children which goods had been brought "
    "from far away: coffee and copper, paper, wool, glass and oranges, and once a grey horse.")

_ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "UPPER": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
_ENCODINGS = [(name, frozenset(symbols), {c: i for i, c in enumerate(symbols)})
              for name, symbols in _ALPHABETS.items()]
_LOWER = {c: i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, by start and then as the kinds are listed."""
    spans = []
    lowered = text.lower()
    if any(word in lowered for word in ASSIGN_WORDS):
        spans += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        spans += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    spans += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def infer_encoding(token: str) -> str | None:
    """The smallest alphabet that holds the token, without end padding."""
    used = set(token)
    for name, symbols, _ in _ENCODINGS:
        if used <= symbols:
            return name
    return None


def _upper_tail(chi: float, freedom: int) -> float:
    """P(chi-squared > chi), by the Wilson-Hilferty cube root."""
    if chi <= 0:
        return 1.0
    part = 2 / (9 * freedom)
    return 0.5 * math.erfc(((chi / freedom) ** (1 / 3) - 1 + part) / math.sqrt(2 * part))


def randomness(values: np.ndarray, alphabet: int) -> float:
    """Fisher's joint p-value of the three tests; small for text, uniform for random strings."""
    n = len(values)
    expected = n / alphabet
    counts = np.bincount(values, minlength=alphabet)
    uniform = _upper_tail(float(((counts - expected) ** 2).sum() / expected), alphabet - 1)
    above = values >= alphabet / 2
    high = int(above.sum())
    low = n - high
    if high == 0 or low == 0:
        runs = 0.0
    else:
        seen = 1 + int((above[1:] != above[:-1]).sum())
        mean = 1 + 2 * high * low / n
        spread = math.sqrt(max(1e-9, 2 * high * low * (2 * high * low - n) / (n * n * (n - 1))))
        runs = math.erfc(abs(seen - mean) / spread / math.sqrt(2))
    centred = values - values.mean()
    total = float((centred ** 2).sum())
    serial = float((centred[1:] * centred[:-1]).sum()) / total if total else 1.0
    serial_p = math.erfc(abs(serial + 1 / n) * math.sqrt(n) / math.sqrt(2))
    joint = -2 * sum(math.log(max(p, 1e-300)) for p in (uniform, runs, serial_p))
    half = joint / 2
    return math.exp(-half) * (1 + half + half * half / 2)


def _control(text: str, start: int, end: int, name: str, values: dict[str, int], words: bool) -> float:
    """The score of as many letters of plain words from beside the candidate.

    For a candidate of ``words`` they stand in the places of its letters, with its capitals.
    """
    size = end - start
    reach = 8 * size + 2 * BANDS[0]

    def letters(part: str) -> str:
        plain = CANDIDATE.sub(" ", part)
        plain = plain.lower() if name in ("hex", "lower") else (
            plain.upper() if name in ("HEX", "UPPER", "base32") else plain)
        return "".join(c for c in plain if c in values and c.isalpha())

    first = max(0, start - reach)
    before = TOKEN_START.sub("", text[first:start])
    near = letters(TOKEN_END.sub("", before) if first else before)[-size:]
    if len(near) < size:
        after = TOKEN_END.sub("", text[end:end + reach])
        near = letters(TOKEN_START.sub("", after) if end + reach < len(text) else after)[:size]
    if len(near) < size:
        own = letters(PASSAGE)
        near = (own * (2 + size // len(own)))[start % len(own):][:size]
    if words:
        near = "".join(c if not c.isalpha() else n.upper() if c.isupper() else n.lower()
                       for c, n in zip(text[start:end], near, strict=True))
    return randomness(np.array([values[c] for c in near]), len(values))


def _runs(text: str, taken: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
    """(start, end) of the long parts of token runs that lie outside the base spans."""
    place = 0
    merged = []
    for a, b, _ in taken:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while place < len(merged) and merged[place][1] <= start:
            place += 1
        next_one = place
        while next_one < len(merged) and merged[next_one][0] < end:
            if merged[next_one][0] - start >= BANDS[0]:
                yield start, merged[next_one][0]
            start = merged[next_one][1]
            next_one += 1
        if end - start >= BANDS[0]:
            yield start, end


def _readings(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """The run itself, or its long parts where no alphabet holds it whole."""
    token = text[start:end]
    if infer_encoding(token) is not None:
        return [(start, end)]
    return sorted({(start + m.start(), start + m.end())
                   for cut in CLASHING for m in cut.finditer(token)})


def candidates(text: str, taken: list[tuple[int, int, str]]):
    """(start, end, encoding, words, score, control) of long tokens that overlap no base span."""
    out = []
    for start, end in (part for run in _runs(text, taken) for part in _readings(text, *run)):
        token = text[start:end]
        name = infer_encoding(token)
        digits = any(c.isdigit() for c in token)
        mixed = any(c.islower() for c in token[1:]) and any(c.isupper() for c in token[1:])
        # a random string over a larger alphabet would have a digit or both cases
        if token.isdigit() or not (digits or mixed or name in ("lower", "UPPER")):
            continue
        values = next(v for n, _, v in _ENCODINGS if n == name)
        score = randomness(np.array([values[c] for c in token]), len(values))
        words = name.startswith("base6") and not STRAY.search(token)
        out.append((start, end, name, words, score, _control(text, start, end, name, values, words)))
    return out


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])
_CANDIDATE = pa.struct([
    ("start", pa.int64()), ("end", pa.int64()), ("encoding", pa.string()),
    ("words", pa.bool_()), ("score", pa.float64()), ("control", pa.float64())])
_SPANS_SQL = ("_s_base array<struct<start:long,end:long,kind:string>>, _s_more array<struct<"
              "start:long,end:long,encoding:string,words:boolean,score:double,control:double>>")


def _scan(batches: Iterator[pa.RecordBatch], text: str, keep_text: bool):
    for batch in batches:
        base, more = [], []
        for one in batch.column(text):
            whole = one.as_py() or ""
            spans = base_spans(whole)
            base.append([dict(start=a, end=b, kind=k) for a, b, k in spans])
            more.append([dict(start=a, end=b, encoding=e, words=w, score=s, control=c)
                         for a, b, e, w, s, c in candidates(whole, spans)])
        names = [n for n in batch.schema.names if keep_text or n != text]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(n) for n in names], pa.array(base, pa.list_(_SPAN)),
             pa.array(more, pa.list_(_CANDIDATE))],
            [*names, "_s_base", "_s_more"])


def _band(length: Column) -> Column:
    band = F.lit(0)
    for number, least in enumerate(BANDS):
        band = F.when(length >= least, number).otherwise(band)
    return band


def thresholds(scanned: DataFrame, max_false: float) -> dict[tuple[str, bool, int], float]:
    """The lowest score, by encoding, words or not and length band, that keeps false finds under ``max_false``."""
    one = scanned.select(F.explode("_s_more").alias("c")).select(
        "c.encoding", "c.words", _band(F.col("c.end") - F.col("c.start")).alias("band"),
        F.explode(F.array(
            F.struct(F.lit(0).alias("control"), F.col("c.score").alias("score")),
            F.struct(F.lit(1).alias("control"), F.col("c.control").alias("score")))).alias("s"))
    step = F.least(F.floor(F.col("s.score") * STEPS), F.lit(STEPS - 1)).cast("int")
    counted = (one.groupBy("encoding", "words", "band", "s.control", step.alias("step")).count().collect())
    tables = {}
    for row in counted:
        table = tables.setdefault((row.encoding, row.words, row.band), np.zeros((2, STEPS), np.int64))
        table[row.control, row.step] = row["count"]
    limits = {}
    for key, table in tables.items():
        above = table[:, ::-1].cumsum(axis=1)[:, ::-1]
        fine = (above[1] <= max_false * above[0]) & (above[0] > 0)
        fine[:round(LEAST * STEPS)] = False
        limits[key] = float(np.argmax(fine)) / STEPS if fine.any() else 2.0
    return limits


def scan_secrets(
    docs: DataFrame, text: str = "text", max_false: float = 0.05, keep_text: bool = True,
) -> DataFrame:
    """``docs`` with ``secrets``: array<struct<start, end, kind, encoding>>, by start and kind.

    Places count code points, ends are exclusive. The scan is stored once, in the shared
    folder, as both the thresholds and the result read it.
    """
    own = docs.drop("secrets")
    names = [f for f in own.schema if keep_text or f.name != text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in names)
    found = own.mapInArrow(lambda batches: _scan(batches, text, keep_text),
                           f"{schema + ', ' if schema else ''}{_SPANS_SQL}")
    scanned = scratch.stored(found, "secrets")
    limits = thresholds(scanned, max_false)

    def passes(c: Column) -> Column:
        band = _band(c.end - c.start)
        least = F.lit(2.0)
        for (encoding, words, number), limit in limits.items():
            one = (c.encoding == encoding) & (c.words == words) & (band == number)
            least = F.when(one, F.lit(limit)).otherwise(least)
        return c.score >= least

    added = F.transform(F.filter("_s_more", passes), lambda c: F.struct(
        c.start.alias("start"), F.lit(3).alias("place"), c.end.alias("end"),
        F.lit("random").alias("kind"), c.encoding.alias("encoding")))
    base = F.transform("_s_base", lambda s: F.struct(
        s.start.alias("start"), (F.array_position(F.lit(KINDS), s.kind) - 1).cast("int").alias("place"),
        s.end.alias("end"), s.kind.alias("kind"), F.lit(None).cast("string").alias("encoding")))
    every = F.transform(F.array_sort(F.concat(base, added)), lambda s: F.struct(
        s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind"),
        s.encoding.alias("encoding")))
    return scanned.withColumn("secrets", every).drop("_s_base", "_s_more")


def span_list(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """``text`` with every span, or run of overlapping spans, put out by ``mark``."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    return F.aggregate(
        spans, start,
        lambda a, s: F.when(s.end <= a.at, a).otherwise(F.struct(
            F.concat(a.out, F.when(s.start >= a.at, F.concat(
                F.substring(text, (a.at + 1).cast("int"), (s.start - a.at).cast("int")),
                F.lit(mark))).otherwise(F.lit(""))).alias("out"),
            s.end.alias("at"))),
        lambda a: F.concat(a.out, F.substring(text, (a.at + 1).cast("int"), F.length(text))))


def redact_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with secrets put out; rows without any come back as they are."""
    found = scan_secrets(numbered(docs, text), text)
    clean = F.when(F.size("secrets") > 0, redacted(F.col(text), F.col("secrets"))).otherwise(
        F.col(text))
    return restored(found.withColumn(text, clean), docs, text)
