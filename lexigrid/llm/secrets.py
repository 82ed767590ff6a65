"""Secret scans: three fixed patterns, and a randomness test battery under length-aware false-discovery control."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm.common import table, written

#: The base patterns in the order of the kinds, and the least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")
ASSIGN_LEAST = 6

#: Tokens that the battery tests, and the alphabets that encodings use, smallest first; of one class of characters: letters of one case only.
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = {
    "hex": DIGITS + LOWER[:6],
    "HEX": DIGITS + UPPER[:6],
    "base26": LOWER,
    "BASE26": UPPER,
    "base32": UPPER + DIGITS[2:8],
    "base36": DIGITS + LOWER,
    "BASE36": DIGITS + UPPER,
    "base52": UPPER + LOWER,
    "base62": DIGITS + UPPER + LOWER,
    "base64": UPPER + LOWER + DIGITS + "+/",
    "base64url": UPPER + LOWER + DIGITS + "-_",
}
VOWELS = set("aeiouyAEIOUY")
#: Under the null of written text, also of words written together with numbers between them: the coincidence rate of letters; the share of
#: neighbours of different character classes, where letters are of one case and of both; of neighbouring letters, a vowel beside a consonant;
#: letters among a to f, and digits from 2 to 7.
TEXT_COINCIDENCE, TEXT_CHANGES, TEXT_VOWELS, TEXT_A_TO_F, TEXT_2_TO_7 = 0.066, (0.18, 0.30), 0.55, 0.32, 0.55
#: A token that fails a randomness test at this level is no secret; the false-discovery rate that each length class keeps to.
REJECT, FDR = 1e-4, 0.01
#: Lower ends of the length classes; cells of -log10(p) per unit, and cells.
CLASSES, STEP, CELLS = (16, 24, 32, 48, 64), 20, 1200


def _tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _chi_tail(x: float, d: float) -> float:
    """P(chi-squared with d degrees of freedom >= x), by Wilson and Hilferty."""
    return _tail(((x / d) ** (1 / 3) - (1 - 2 / (9 * d))) / math.sqrt(2 / (9 * d)))


def _upto(t: int, n: int, c: float) -> float:
    """P(at most t of n) where each has probability c."""
    if n < 400:
        return min(1.0, sum(math.comb(n, i) * c**i * (1 - c) ** (n - i) for i in range(t + 1)))
    return _tail((n * c - t) / math.sqrt(n * c * (1 - c)))


def _fisher(ps: list[float]) -> float:
    """One p-value of several: chi-squared with two degrees of freedom for each."""
    y, term, total = -sum(math.log(max(p, 1e-60)) for p in ps), 1.0, 1.0
    for i in range(1, len(ps)):
        term *= y / i
        total += term
    return min(1.0, math.exp(-y) * total)


def encoding(token: str) -> str | None:
    """The smallest encoding whose alphabet holds the token; none for numbers, and for one case of letters with other signs, as paths are."""
    chars = set(token)
    classes = sum(bool(chars & set(c)) for c in (DIGITS, LOWER, UPPER))
    if not chars & set(LOWER + UPPER) or (classes < 2 and not chars <= set(LOWER) and not chars <= set(UPPER)):
        return None
    return next((k for k, a in ENCODINGS.items() if chars <= set(a)), None)


def battery(token: str) -> tuple[float, float] | None:
    """(p if random, p if text) of a token, or None if it has no encoding.

    Three tests look at the token in its encoding's alphabet: chi-squared uniformity, runs, and the serial correlation of neighbours. If
    random: the smallest of their p-values (runs above and below the alphabet's middle), times three. If text: Fisher's combination of how likely
    text of this length is to come as near to what randomness gives, in each test:
    - chi-squared as low, where the letters' coincidence rate raises it;
    - as many runs, of character classes;
    - as little serial correlation, of vowels and consonants, which text alternates, among neighbouring letters;
    and to keep to the letters and digits of a small alphabet.
    """
    token = token.rstrip("=")
    if (name := encoding(token)) is None:
        return None
    alphabet = ENCODINGS[name]
    at = {c: i for i, c in enumerate(alphabet)}
    x, k, n = np.array([at[c] for c in token]), len(alphabet), len(token)
    chi = float((np.bincount(x, minlength=k) ** 2).sum() * k / n - n)
    p_chi = _chi_tail(max(chi, 1e-9), k - 1)
    high = x >= k / 2
    a, b = int(high.sum()), int((~high).sum())
    p_runs = 1.0
    if a and b and n > 3:
        mean = 1 + 2 * a * b / n
        sd = math.sqrt(max(1e-9, (mean - 1) * (mean - 2) / (n - 1)))
        p_runs = 2 * _tail(abs(1 + int((high[1:] != high[:-1]).sum()) - mean) / sd)
    c = x - x.mean()
    serial = float((c[1:] * c[:-1]).sum() / max(1e-9, (c * c).sum()))
    if_random = min(1.0, 3 * min(p_chi, p_runs, 2 * _tail(abs(serial) * math.sqrt(n))))
    text = []
    if (excess := k * TEXT_COINCIDENCE - 1) > 0:
        mean, sd = (k - 1) + (n - 1) * excess, math.sqrt(2 * (k - 1) + 4 * (n - 1) * excess)
        text.append(max(1e-30, _tail((mean - chi) / sd)))
    kind = np.array([0 if ch in DIGITS else 1 if ch in LOWER else 2 if ch in UPPER else 3 for ch in token])
    if len(set(kind.tolist())) > 1:
        t = int((kind[1:] != kind[:-1]).sum())
        text.append(max(1e-60, 1 - _upto(t - 1, n - 1, TEXT_CHANGES[1 in kind and 2 in kind])) if t < n * 0.9 else 1e-12)
    letter = (kind == 1) | (kind == 2)
    vowel = np.array([ch in VOWELS for ch in token])
    beside = letter[1:] & letter[:-1]
    if m := int(beside.sum()):
        text.append(_upto(int((beside & (vowel[1:] != vowel[:-1])).sum()), m, TEXT_VOWELS))
    if name in ("hex", "HEX"):
        text.append(TEXT_A_TO_F ** int(letter.sum()))
    elif name == "base32":
        text.append(TEXT_2_TO_7 ** int((kind == 0).sum()))
    return if_random, _fisher(text)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, sorted; a kind is its place in KINDS."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def tested(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, float, float]]:
    """(start, end, p if random, p if text) of the tokens that no base span covers."""
    starts, reach = [a for a, _, _ in base], list(accumulate((b for _, _, b in base), max))
    out = []
    for m in TOKEN.finditer(text):
        before = bisect_right(starts, m.start())
        if (before and reach[before - 1] >= m.end()) or (p := battery(m[0])) is None:
            continue
        out.append((m.start(), m.end(), *p))
    return out


def length_class(length: int) -> int:
    return bisect_right(CLASSES, length) - 1


def cell(if_random: float, if_text: float) -> int:
    """Where a token stands in its class's histogram, by falling p-value of text; 0 if it is not random."""
    return min(CELLS - 1, int(-math.log10(max(if_text, 1e-300)) * STEP)) if if_random >= REJECT else 0


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
TEST = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("length_class", pa.int32()), ("cell", pa.int32()), ("token", pa.int64())])
FOUND = pa.schema([("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("base", pa.list_(SPAN)), ("tests", pa.list_(TEST))])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            text = text or ""
            base = base_spans(text)
            tests = [
                {"start": a, "end": b, "length_class": length_class(b - a), "cell": cell(p, q), "token": xxhash.xxh3_64_intdigest(text[a:b]) - (1 << 63)}
                for a, b, p, q in tested(text, base)
            ]
            counts = {f"n_{KINDS[i]}": sum(k == i for _, k, _ in base) for i in range(3)}
            spans = [{"start": a, "kind": k, "end": b} for a, k, b in base]
            rows.append({**counts, "base_sha256": hashlib.sha256(_listed(base).encode()).hexdigest(), "base": spans, "tests": tests})
        got = pa.RecordBatch.from_pylist(rows, schema=FOUND)
        yield pa.record_batch([batch.column("doc_id"), *got.columns], names=["doc_id", *FOUND.names])


def thresholds(counts: dict[tuple[int, int], int]) -> list[int]:
    """The least cell that counts as a discovery in each length class, by Benjamini and Hochberg on counts[(class, cell)]; CELLS if none does."""
    out = []
    for c in range(len(CLASSES)):
        n = np.array([counts.get((c, i), 0) for i in range(CELLS)])
        beyond, p = n[::-1].cumsum()[::-1], 10.0 ** -(np.arange(CELLS) / STEP)
        good = np.flatnonzero((beyond > 0) & (p * n.sum() <= FDR * beyond))
        out.append(int(good[0]) if len(good) else CELLS)
    return out


def scan(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random.

    Null and empty texts have no spans (the digest and list of the empty string). Repeated rows are scanned each; an empty
    table gives no rows; other columns, whatever their names, play no part. The p-values of all distinct tokens of the table enter the
    false-discovery control, as a histogram of fixed size per length class: copies add nothing. Tokens of one cell are found or left together.
    """
    schema = (
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, "
        "base array<struct<start:long,kind:int,end:long>>, tests array<struct<start:long,end:long,length_class:int,cell:int,token:long>>"
    )
    found = written(docs.select("doc_id", "text").mapInArrow(_scan, schema), "secret-spans")
    tests = found.select(F.explode("tests").alias("t")).select("t.length_class", "t.cell", "t.token").distinct().groupBy("length_class", "cell").count()
    least = thresholds({(r[0], r[1]): r[2] for r in tests.collect()})  # len(CLASSES) * CELLS rows at most
    bound = F.array(*[F.lit(x) for x in least])
    more = F.filter("tests", lambda t: t["cell"] >= F.get(bound, t["length_class"]))
    more = F.transform(more, lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")))
    name = F.array(*[F.lit(k) for k in KINDS])
    spans = F.array_join(F.transform(F.array_sort(F.concat("base", more)), lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ",")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", spans.alias("spans"), F.size(more).cast("long").alias("n_random"))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents."""
    return scan(table(spark, sf_dir, "documents"))
