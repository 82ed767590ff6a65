"""Each query on whole small tables against a brute-force version, its SQL, a round trip or held-out accuracy."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexigrid.llm import embedding_dedup, jaccard_join, mixing, packing, pii, registry, secrets, signature_tree, suffix_dedup, toxicity
from lexigrid.llm.common import components, shingle_set, word_hashes, words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, duck, name):
    ours = registry.QUERIES[name](spark, SF)
    theirs = duck.sql(registry.SQL[name])
    order = sorted(ours.columns)
    assert order == sorted(theirs.columns)
    pick = lambda rows, cols: sorted(tuple(r[cols.index(c)] for c in order) for r in rows)
    assert pick([tuple(r) for r in ours.collect()], ours.columns) == pick(theirs.fetchall(), theirs.columns)


def test_words():
    t = "A b\tC\x0bÄ\x85x\xa0y  zÉ\n"
    want = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if w]
    assert [w.decode() for w in words(t)] == want and len(word_hashes(t)) == len(want)
    assert word_hashes("x A x")[0] == word_hashes("x a b")[0] != word_hashes("x a b")[2]
    assert len(shingle_set("a b c d a b c d", 4)) == 4 and len(shingle_set("a b", 4)) == 1 and len(shingle_set(" ", 4)) == 0


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (250, 2))] + [(k, k + 1) for k in range(500, 560)] + [(900, k) for k in range(901, 960)]
    parent = {}

    def root(k):
        while parent.setdefault(k, k) != k:
            k = parent[k]
        return k

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    assert got == {k: root(k) for k in got} and set(got) == {k for e in edges if e[0] != e[1] for k in e}


# --- 1 ------------------------------------------------------------------------------------------------------------------
def test_secret_patterns():
    t = "API_KEY = 'abc12' token: \"abcdef\" passwd=a.b/c-d= AKIA" + "B" * 16 + " AKIAB " + "0a" * 12 + " " + "ſecret=abcdefg" + " secret=token=xyz"
    got = secrets.base_spans(t)
    assert [(secrets.KINDS[k], t[a:b]) for a, k, b in got] == [("assign", 'token: "abcdef'), ("assign", "passwd=a.b/c-d="), ("access", "AKIA" + "B" * 16), ("hex", "0a" * 12), ("assign", "secret=token=xyz")]


def test_secret_battery(spark):
    rng = np.random.default_rng(5)
    real = ["".join(rng.choice(list(secrets.ENCODINGS[e]), n)) for e in ("hex", "base62", "base64") for n in (32, 40, 64) for _ in range(15)]
    fake = ["internationalisationMatters", "getElementsByClassName", "section12paragraph34page5", "XXyy0000000000a0000", "TheReaderOfThisTextHasSeen2Errors", "aaaaaaaaaaaaaaaaAAAAAAAAAAAAAAAA"] * 6
    rows = [(k, f"we keep {x} here") for k, x in enumerate(real + fake)]
    got = {r.doc_id: r.n_random + r.n_hex for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[k] > 0 for k in range(len(real))) >= 0.9 * len(real)
    assert sum(got[k] for k in range(len(real), len(rows))) <= 1


def test_secret_discoveries(spark):
    """Benjamini and Hochberg over the battery's own p-values of distinct tokens, sorted, beside the histogram; copies of a text change nothing."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(["tion", "er", "an", "ing", "ch", "Ein", "les", "Que", "12", "der"], 7))
    tokens = [word() for _ in range(300)] + ["".join(rng.choice(list(a), int(rng.integers(16, 70)))) for a in secrets.ENCODINGS.values() for _ in range(12)]
    tokens = [t for t in tokens if len(t) >= 16]
    rows = [(k, f"so {t}, {t}") for k, t in enumerate(tokens)] + [(10_000 + k, f"so {tokens[0]}") for k in range(200)]
    got = {r.doc_id: r for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    tests = {t: secrets.battery(t) for t in set(tokens) if not secrets.base_spans(t) and secrets.battery(t)}
    found = set()
    for c in range(len(secrets.CLASSES)):
        ps = sorted((10 ** -(secrets.cell(*p) / secrets.STEP), t) for t, p in tests.items() if secrets.length_class(len(t)) == c)
        last = max([i for i, (p, _) in enumerate(ps, 1) if p <= secrets.FDR * i / len(ps)], default=0)
        found |= {t for _, t in ps[:last]}
    assert 20 < len(found) < len(tests) - 50
    for k, t in enumerate(tokens):
        want = [(m.start(), 3, m.end()) for m in re.finditer(re.escape(t), rows[k][1])] if t in found else []
        assert got[k].spans == secrets._listed(sorted(secrets.base_spans(rows[k][1]) + want)) and got[k].n_random == len(want)
    assert sum(t in found for t in tokens[:300]) <= 3


def test_secret_recall():
    """The share of random tokens that would be found among as many written ones, by encoding and length (README has the table)."""
    rng = np.random.default_rng(11)
    share = lambda e, n: np.mean([secrets.cell(*(secrets.battery("".join(rng.choice(list(secrets.ENCODINGS[e]), n))) or (1, 1))) >= 2 * secrets.STEP for _ in range(200)])
    for e, least in {"base62": (0.8, 0.95, 0.99), "base64": (0.85, 0.95, 0.99), "HEX": (0.65, 0.85, 0.95), "base36": (0.5, 0.75, 0.9), "base32": (0.35, 0.65, 0.85), "base26": (0.1, 0.3, 0.5)}.items():
        assert all(share(e, n) >= x for n, x in zip((16, 24, 32), least, strict=True)), e


def test_base_spans_in_long_texts():
    """Which tokens a span covers is found without looking at all spans of the text."""
    import time

    text = "token=abcdef1 x9Kq2Lm8Zp4Rt7Vb3 " * 20_000
    base, began = secrets.base_spans(text), time.time()
    assert len(base) == 20_000 == len(secrets.tested(text[:3200], base[:100])) * 200 and time.time() - began < 5


def test_secret_query(spark, texts):
    for r in registry.QUERIES["op1_secrets"](spark, SF).collect():
        t = texts[r.doc_id].text or ""
        spans = [(m.start(), 0, m.end()) for m in secrets.ASSIGN.finditer(t) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        base = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and set(filter(None, base.split(","))) <= set(r.spans.split(","))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in spans) for k in range(3))


# --- 2 ------------------------------------------------------------------------------------------------------------------
def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in registry.QUERIES["op2_toxicity"](spark, sf).collect()}
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for k, r in got.items())
    held = [(got[k].score, y) for k, y in marks.items() if got[k].held_out]
    pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
    assert sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg)) > 0.9


def test_toxicity_scores(spark, texts):
    """Scores from n-grams cut out of the text one by one, and counts of documents, ratios and sums written out."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(900, "Ünïcödé ДА да 漢字 漢字"), (901, ""), (902, None), (903, "a")], "doc_id long, text string"))

    def cells(text):
        plain, out = " " + " ".join((text or "").lower().split()) + " " if text else "", set()
        for n in toxicity.SIZES:
            for i in range(len(plain) - n + 1):
                h = ord(plain[i])
                for k in range(1, n):
                    h = (h * 16777619 + ord(plain[i + k]) + k + 1) % 2**32
                out.add((h * 2654435761 % 2**32) >> (32 - toxicity.BITS))
        return out

    weights = np.random.default_rng(2).standard_normal(1 << toxicity.BITS).astype(np.float32) * 0.01
    got = {r.doc_id: r.score for r in toxicity.score(docs, (weights, -0.5), ["doc_id"]).collect()}
    known = {k: cells(r.text) for k, r in texts.items()} | {900: cells("Ünïcödé ДА да 漢字 漢字"), 901: set(), 902: set(), 903: cells("a")}
    for k, c in known.items():
        assert got[k] == pytest.approx(1 / (1 + math.exp(0.5 - sum(float(weights[i]) for i in sorted(c)))), rel=1e-6), k
    df = np.zeros((2, 1 << toxicity.BITS), int)
    for k in range(40):
        df[int(k % 3 == 0), sorted(known[k])] += 1
    ratio = toxicity.scaled_ratios(df, [26, 14])
    for i in sorted(set.union(*(known[k] for k in range(40))))[::500]:
        p, q = df[1, i] + 0.5, df[0, i] + 0.5
        r = math.log(p / 15) - math.log(q / 27)
        want = r * min(1, abs(r) / math.sqrt(1 / p + 1 / q) / toxicity.WHOLE) if df[:, i].sum() >= toxicity.LEAST else 0
        assert ratio[i] == pytest.approx(want, abs=1e-6)


def test_toxicity_fit_is_at_its_optimum():
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 300, 40)).astype(np.int32) for _ in range(80)]
    y = np.array([float(len(r) and (r < 20).sum() + rng.random() > 3) for r in rows])
    ratio = np.zeros(1 << toxicity.BITS, np.float32)
    ratio[:300] = rng.standard_normal(300)
    sample = toxicity.Sample(rows, np.array([len(r) for r in rows]))
    w, b = toxicity.fit(sample, y, ratio, steps=400)

    def loss(w, b):
        z = np.array([w[r].sum() for r in rows]) + b
        each = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
        v = np.divide(w[:300], ratio[:300])
        return (each * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (v @ v) / len(y)

    w, best = w.astype(float), None
    best = loss(w, b)
    for _ in range(60):
        d = np.zeros_like(w)
        d[:300] = rng.standard_normal(300) * ratio[:300] * 0.02
        assert loss(w + d, b + 0.02 * rng.standard_normal()) > best - 0.002


# --- 3 ------------------------------------------------------------------------------------------------------------------
def check_packing(rows, texts, tok):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for k, t in texts.items():
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(by_doc[k], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    used = []
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
        used.append(at)
    return used


def test_packing(spark, texts):
    used = check_packing(registry.QUERIES["op3_packing"](spark, SF).collect(), {k: r.text for k, r in texts.items()}, packing.tokenizer(packing.default_vocabulary())[0])
    assert sum(used) / (4096 * len(used)) > 0.97


def test_tokens_equal_the_library():
    tok = packing.tokenizer(packing.default_vocabulary())[0]
    odd = ["it's 1's ''s don't we'll x'LL", "ab<|endoftext|>cd", "İstanbul ſtraße ÅNGSTRÖM ª º µ", "a\x1cb\x85c\xa0d\x0be", "日本 кириллица", "2²½ 10.5$%&", "", "é", "'S'T"]
    for t, b in zip(odd, packing.token_bytes(odd, packing.default_vocabulary()), strict=True):
        assert b == np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()


def test_patterns_hold_the_demand():
    rng = np.random.default_rng(2)
    demand = Counter()
    for n in np.exp(rng.normal(6, 1.4, 3000)).astype(int):
        demand.update(length for _, length in packing.cuts(int(n) + 1))
    plan = packing.patterns(dict(demand))
    held = Counter()
    for counts, n in plan:
        assert sum(k * c for k, c in counts.items()) <= 4096
        held.update({k: c * n for k, c in counts.items()})
    assert held == demand
    assert sum(k * n for k, n in demand.items()) / (4096 * sum(n for _, n in plan)) > 0.99


# --- 4 ------------------------------------------------------------------------------------------------------------------
def luhn(s):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def test_surrogates(spark):
    t = [
        "Mail ann.lee7@corp.example.org, or ANN.LEE7@CORP.EXAMPLE.ORG; call +1 (017) 555-7713 or +1 017 555 7713.",
        "Card 4929 3483 8514 6306? no: 4111 1111 1111 1111 and 4111111111111111; not 2123465659789240, nor 1234567890123.",
        "Frau Anna Schmidt met Herr Schmidt and Mr. JONES at 10.0.0.1; Госпожа Анна Иванова left. Version 1.2.3.4.5 stays, 300.1.1.1 too.",
        "nothing here", None, "x" * 100_000 + "@", "a" * 70 + "@mail.example.com",
    ]
    got = {r.doc_id: r for r in pii.anonymise(spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")).collect()}
    a, b, c = (got[k].text for k in range(3))
    mails = re.findall(r"\S+@[\w.]+\w", a)
    assert mails[0].lower() == mails[1].lower() != "ann.lee7@corp.example.org" and mails[1].isupper() and re.fullmatch(r"[a-z]{3}\.[a-z]{3}\d@[a-z]{4}\.example\.(com|org|net)", mails[0])
    phones = re.findall(r"\+1 [\d() -]+\d", a)
    assert re.sub(r"\D", "", phones[0]) == re.sub(r"\D", "", phones[1]) != "10175557713" and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", phones[0])
    cards = re.findall(r"4[\d ]{14,18}\d", b)
    assert cards[1].replace(" ", "") == cards[2] != "4111111111111111" and luhn(cards[2]) and "2123465659789240" in b and "1234567890123" in b
    assert luhn("4929348385146306") == (cards[0] != "4929 3483 8514 6306")
    names = re.match(r"Frau (\w+) (\w+) met Herr (\w+) and Mr. (\w+) at (\S+); Госпожа (\w+) (\w+) left. Version 1.2.3.4.5 stays, 300.1.1.1 too.", c)
    assert names and names[2] == names[3] != "Schmidt" and names[4].isupper() and names[5] != "10.0.0.1" and re.fullmatch("[А-Яа-я]+", names[6])
    assert all(got[k].text == t[k] for k in (3, 4, 5)) and got[2].n_entities == 5


def test_surrogates_stay_distinct(spark):
    t = [f"Mr. A{chr(97 + k % 26)}{chr(97 + k // 26)} wrote from 10.1.{k}.7 and u{k}@a.example.com" for k in range(200)]
    got = [r.text for r in pii.anonymise(spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")).orderBy("doc_id").collect()]
    for pick in (r"Mr\. (\w+)", r"from (\S+)", r"(\S+@\S+)"):
        new, old = ([re.search(pick, x)[1].lower() for x in y] for y in (got, t))
        assert len(set(new)) == len(set(old)) == 200 and not set(new) & set(old)


def test_whole_names_phones_and_scripts(spark):
    t = [
        "Dr Anna Maria Kowalska spoke. Kowalska said so, KOWALSKA too; Kowalskas stay. Señora Ana García de la Vega met Herr Dr. Vega.",
        "Call +15551234567, +1 5551234567, 555 123 4567 or (555) 123-4567; not 1 555 123 4567 8.",
        "Write to 李明@firma.de or ελένη@firma.de.",
        "Kowalska alone stays: no title names her here.",
    ]
    a, b, c, d = (r.text for r in pii.anonymise(spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")).orderBy("doc_id").collect())
    names = re.fullmatch(r"Dr (\w+) (\w+) (\w+) spoke\. (\w+) said so, (\w+) too; Kowalskas stay\. Señora (\w+) (\w+) de la (\w+) met Herr Dr\. (\w+)\.", a)
    assert names and names[3] == names[4] and names[5] == names[3].upper() and names[8] == names[9]
    assert not {"Anna", "Maria", "Kowalska", "KOWALSKA", "Ana", "García", "Vega"} & set(names.groups())
    phones = re.fullmatch(r"Call \+1(\d{10}), \+1 (\d{10}), (\d{3} \d{3} \d{4}) or \((\d{3})\) (\d{3})-(\d{4}); not 1 555 123 4567 8\.", b)
    assert phones and phones[1] == phones[2] != "5551234567" and phones[3] == " ".join(phones.groups()[3:]) != "555 123 4567"
    assert re.fullmatch(r"Write to [\u4e00-\u9fff]{2}@\w{5}\.example\.\w{3} or [\u0370-\u03ff]{3,5}@\w{5}\.example\.\w{3}\.", c) and "李明" not in c and "ελένη" not in c
    assert d == t[3]


def test_more_names_than_short_surrogates(spark):
    """100,000 family names, where there are 17,408 of the first attempt, and 10,000 addresses, where there are 315: none shares a surrogate."""
    wide = lambda c: F.translate(F.format_string("%05d", c), "0123456789", "qwzxpjkvbg")
    names = spark.range(100_000).select(F.lit("last").alias("type"), wide("id").alias("canon"), F.lit("").alias("gender"))
    mails = spark.range(10_000).select(F.lit("email").alias("type"), F.concat(wide("id"), F.lit("@b.com")).alias("canon"), F.lit("").alias("gender"))
    mails = mails.withColumn("canon", F.regexp_replace("canon", "^(.).*(.)@", "$1@")).distinct().unionByName(mails)
    parts = names.unionByName(mails).distinct()
    again = pii._attempts(parts, "surrogates").select("type", "canon", "attempt")
    new = parts.join(again, ["type", "canon"], "left").select("type", "canon", pii.surrogate(F.struct("type", "canon", "gender"), F.coalesce("attempt", F.lit(0)), "surrogates").alias("new"))
    assert new.select("type", "new").distinct().count() == parts.count() and new.join(new.select("type", F.col("new").alias("canon")), ["type", "canon"], "left_semi").isEmpty()


def test_coreference(spark, monkeypatch):
    """One surrogate a name over titles, texts and forms, by the map and by the join alike; columns of all names pass through."""
    t = [
        "Mr. John Smith called (212) 555-7713. Later Smith said John was ill. Dr. John Smith agreed.",
        "Prof John Miller and Mrs. Robin Miller; call +1 (212) 555-7713 or +12125557713. Dr. Robin Hale too.",
        "From 2001:db8:0:1:1:1:1:1 and fe80::1ff:fe23:4567:890a at 12:30:45; a std::vector stays.",
        *[f"Mr. John Q{chr(97 + k // 26)}{chr(97 + k % 26)} wrote" for k in range(400)],
    ]
    df = spark.createDataFrame([(k, x, k, k, k, k) for k, x in enumerate(t)], "doc_id long, text string, n_entities int, sha int, type int, canon int")
    got = []
    for most in (10_000, 0):
        monkeypatch.setattr(pii, "MAP_ROWS", most)
        out = pii.anonymise(df)
        assert out.columns == [*df.columns, "_n_entities"]
        rows = sorted(out.collect(), key=lambda r: r.doc_id)
        assert all(r.n_entities == r.sha == r.canon == r.doc_id for r in rows)
        got.append([r.text for r in rows])
    assert got[0] == got[1]
    a = re.fullmatch(r"Mr\. (\w+) (\w+) called \((\d{3})\) (\d{3})-(\d{4})\. Later (\w+) said (\w+) was ill\. Dr\. (\w+) (\w+) agreed\.", got[0][0])
    assert a and a[1] == a[7] == a[8] != "John" and a[2] == a[6] == a[9] != "Smith" and a[1].lower().endswith(tuple(pii.ENDINGS["latin", "m"]))
    b = re.fullmatch(r"Prof (\w+) (\w+) and Mrs\. (\w+) (\w+); call \+1 \((\d{3})\) (\d{3})-(\d{4}) or \+1(\d{10})\. Dr\. (\w+) (\w+) too\.", got[0][1])
    assert b and b[1] == a[1] and b[2] == b[4] and b[3] == b[9] and b[3].lower().endswith(tuple(pii.ENDINGS["latin", "f"]))
    assert b[8] == b[5] + b[6] + b[7] == a[3] + a[4] + a[5] != "2125557713"
    c = re.fullmatch(r"From ([0-9a-f:]+) and ([0-9a-f:]+) at 12:30:45; a std::vector stays\.", got[0][2])
    assert c and c[1] != "2001:db8:0:1:1:1:1:1" and c[1].count(":") == 7 and "::" in c[2] and c[2] != "fe80::1ff:fe23:4567:890a"
    last = {x.split()[2] for x in got[0][3:]}
    assert len(last) == 400 and {x.split()[1] for x in got[0][3:]} == {a[1]}


def test_clean_texts_stay(spark, texts):
    planted = re.compile(r"@|\d{3}")
    for r in registry.QUERIES["op4_pii"](spark, SF).collect():
        if not planted.search(texts[r.doc_id].text):
            assert r.text == texts[r.doc_id].text and r.n_entities == 0


# --- 5 ------------------------------------------------------------------------------------------------------------------
def removed(texts, length=100):
    seen, out = set(), {}
    for k in sorted(texts):
        b = (texts[k] or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = True
            seen.add(w)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[k] = (len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def test_repeats(spark, texts):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in registry.QUERIES["op5_suffix_dedup"](spark, SF).collect()}
    assert got == removed({k: r.text for k, r in texts.items()})


def test_repeats_by_window(spark, monkeypatch):
    """Anchors of many unequal segments are dealt by the windows' hashes: the same result."""
    rng = np.random.default_rng(3)
    word = lambda n: "".join(rng.choice(list("abcd "), n))
    passage = word(160)
    t = {k: word(int(rng.integers(0, 200))) + passage[: int(rng.integers(90, 160))] + word(50) for k in range(40)} | {50: "ab" * 400, 51: None, 52: word(99)}
    monkeypatch.setattr(suffix_dedup, "HOT", 1)
    df = spark.createDataFrame(list(t.items()), "doc_id long, text string")
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df).collect()} == removed(t)


def test_repeats_of_hot_anchors(spark, monkeypatch):
    """What transforms get grows with the texts, not with length times the windows, however often an anchor occurs."""
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    line, met, get = word(120), spark.sparkContext.accumulator(0), suffix_dedup._expand
    t = {k: word(80) + line + word(80) for k in range(150)} | {200: line, 201: line[:-1] + "x" + line}

    def counted(length):
        of = get(length)

        def bucket(part):
            met.add(sum(len(x) for x in part["bytes"].to_pylist()))
            return of(part)

        return bucket

    monkeypatch.setattr(suffix_dedup, "HOT", 20)
    monkeypatch.setattr(suffix_dedup, "_expand", counted)
    df = spark.createDataFrame(list(t.items()), "doc_id long, text string")
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df).collect()} == removed(t)
    assert met.value <= sum(map(len, t.values()))


def test_parts_of_segments():
    """Segments that have an equal window in another one reach the transform with it."""
    rng = np.random.default_rng(6)
    passages = [rng.integers(97, 101, 130).astype(np.uint8) for _ in range(4)]
    texts = [np.concatenate([rng.integers(97, 101, 60), passages[k % 4][k % 7 : 90 + k], rng.integers(97, 101, 40)]).astype(np.uint8) for k in range(40)]
    runs = [(t, *x) for t in texts for x in zip(*suffix_dedup.anchored(t, 100), strict=True)]
    segments, h = [t[lo : lo + n + 99] for t, _, lo, n in runs], np.array([x[1] for x in runs])
    some, skip, n = suffix_dedup.needed(segments, h, 100)
    windows = lambda k, a, m: [segments[k][s : s + 100].tobytes() for s in range(a, a + m)]
    every = Counter(w for k in range(len(segments)) for w in windows(k, 0, len(segments[k]) - 99))
    left = Counter(w for k, a, m in zip(some, skip, n, strict=True) for w in windows(k, a, m))
    assert max(every.values()) > 1 and {w: c for w, c in every.items() if c > 1} == {w: c for w, c in left.items() if c > 1}
    assert left.total() < every.total() / 2
    assert suffix_dedup.needed(segments, h + np.uint64(1), 100)[0].tolist() == list(range(len(segments)))


def test_interval_expansion():
    rng = np.random.default_rng(4)
    segments = [rng.integers(97, 99, int(n)).astype(np.uint8) for n in rng.integers(5, 60, 30)]
    for length in (1, 7, 12):
        group, seg, off = suffix_dedup.repeats(segments, length)
        named = defaultdict(set)
        for g, s, o in zip(group, seg, off, strict=True):
            named[g].add(segments[s][o : o + length].tobytes())
        assert all(len(x) == 1 for x in named.values()) and len(named) == len(set.union(*named.values()))
        assert len(group) == sum(max(0, len(s) - length + 1) for s in segments)


# --- 8 and 10 -----------------------------------------------------------------------------------------------------------
def groups(n, links):
    parent = list(range(n))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return [root(k) for k in range(n)]


@pytest.mark.parametrize("block", [7, 1500])
def test_jaccard_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rng = np.random.default_rng(6)
    base = [rng.integers(0, 50, int(rng.integers(4, 60))) for _ in range(6)]
    texts = []
    for _ in range(120):
        w = base[rng.integers(0, 6)].copy()
        for _ in range(int(rng.integers(0, 4))):
            w[rng.integers(0, len(w))] = rng.integers(0, 500)
        texts.append(" ".join(f"w{x}" for x in w[: len(w) - int(rng.integers(0, 3))]))
    sets = [set(shingle_set(t, 4).tolist()) for t in texts]
    want = groups(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])])
    got = jaccard_join.join_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 4, 85, 100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == {k: (len(sets[k]), want[k]) for k in range(len(texts))}


@pytest.mark.parametrize("block", [20, 4096])
def test_cover_tree_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(7)
    centre = rng.standard_normal((12, 8))
    v = np.concatenate([centre[rng.integers(0, 12, 150)] + 0.25 * rng.standard_normal((150, 8)), centre + 0.01 * rng.standard_normal((12, 8))])
    label = [int(x) for x in rng.integers(0, 2, len(v))]
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.93) & (np.array(label)[:, None] == np.array(label)[None, :])
    np.fill_diagonal(near, False)
    want = groups(len(v), [(i, j) for i in range(len(v)) for j in range(i) if near[i, j]])
    df = spark.createDataFrame([(k, [float(x) for x in v[k]], label[k]) for k in range(len(v))], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df, 0.93).collect()}
    assert got == {k: (int(near[k].sum()), want[k]) for k in range(len(v))} and near.sum() > 50


def test_cells_leave_far_blocks_out(spark, monkeypatch):
    """Well-parted groups: few nodes visit another cell, and the counts stay exact."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 40)
    rng = np.random.default_rng(9)
    centre = rng.standard_normal((10, 64))
    v = np.repeat(centre, 60, axis=0) + 0.08 * rng.standard_normal((600, 64))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.93
    df = spark.createDataFrame([(k, [float(x) for x in v[k]], 1) for k in range(600)], "vec_id long, embedding array<double>, label int")
    nodes = df.select("label", F.size("embedding").alias("dim"), F.col("vec_id").alias("node"), F.lit(1).cast("long").alias("size"), F.col("embedding").alias("v"))
    homes, guests = embedding_dedup._celled(nodes, nodes.groupBy("label", "dim").agg(F.count("*").alias("n")), 0.93)
    cells = homes.select("cell").distinct().count()
    assert homes.count() == 600 and 10 <= cells <= 30 and guests.count() < 600 * (cells - 1) / 2 / 8  # a tenth of the cells are a group's own
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df, 0.93).collect()}
    assert got == {k: int(near[k].sum()) - 1 for k in range(600)} and near.sum() > 6000


def test_centres_are_few_where_points_are_far_apart(spark, monkeypatch):
    """Points without near ones: every one is a child of the root, and still there are no more cells than asked for."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 100)
    v = np.random.default_rng(4).standard_normal((500, 64))
    df = spark.createDataFrame([(k, [float(x) for x in v[k]], 1) for k in range(500)], "vec_id long, embedding array<double>, label int")
    nodes = df.select("label", F.size("embedding").alias("dim"), F.col("vec_id").alias("node"), F.lit(1).cast("long").alias("size"), F.col("embedding").alias("v"))
    homes, guests = embedding_dedup._celled(nodes, nodes.groupBy("label", "dim").agg(F.count("*").alias("n")), 0.93)
    assert homes.select("cell").distinct().count() <= 10 and guests.count() <= 500 * 9
    assert {r.n_links for r in embedding_dedup.near_duplicates(df, 0.93).collect()} == {0}


# --- 9 ------------------------------------------------------------------------------------------------------------------
def filled(sizes, weights, ceiling=3.0):
    """Targets by repeated resharing."""
    total, target, full = float(sum(sizes)), [0.0] * len(sizes), set()
    while True:
        free = [k for k in range(len(sizes)) if k not in full]
        left = total - sum(ceiling * sizes[k] for k in full)
        heft = sum(weights[k] for k in free)
        target = [ceiling * sizes[k] if k in full else left * weights[k] / heft for k in range(len(sizes))]
        over = {k for k in free if target[k] > ceiling * sizes[k] + 1e-9}
        if not over:
            return target
        full |= over


def test_mixing(spark, texts):
    rows = registry.QUERIES["op9_mixing"](spark, SF).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, registry.QUERIES["op9_mixing"](spark, SF).collect()))
    size = {k: len(words(r.text)) for k, r in texts.items()}
    sources = sorted({r.source for r in texts.values()})
    per = {s: sum(size[k] for k, r in texts.items() if r.source == s) for s in sources}
    target = dict(zip(sources, filled([per[s] for s in sources], [(5, 2, 1)[k % 3] for k in range(len(sources))]), strict=True))
    taken = Counter()
    for r in rows:
        s = texts[r.doc_id].source
        assert (r.size, r.source_size) == (size[r.doc_id], per[s]) and r.target == pytest.approx(target[s]) and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in sources)


def test_targets(spark):
    for sizes in ([10, 1, 1], [1, 100, 50, 3, 3, 900], [5], [0, 7]):
        df = spark.createDataFrame([(f"s{k}", n) for k, n in enumerate(sizes)], "source string, source_size long")
        got = [r.target for r in mixing.targets(df, [5, 2, 1], 3.0).orderBy("source").collect()]
        assert got == pytest.approx(filled(sizes, [(5, 2, 1)[k % 3] for k in range(len(sizes))]) if sum(sizes) else [0] * len(sizes))


def test_heavier_documents_come_first(spark):
    rows = [(k, "word " * 10 if k % 2 else "12345678 " * 10, "a") for k in range(2000)] + [(9999, "x " * 40_000, "b")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), [1, 5]).collect()
    part = Counter(r.doc_id % 2 for r in got if r.part and r.source == "a")
    assert part[1] > 2 * part[0] > 0


# --- the pipeline -------------------------------------------------------------------------------------------------------
def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    keep = lambda df: spark.createDataFrame(df.collect(), df.schema)
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    toxic = {r.doc_id for r in toxicity.score(docs, model, ["doc_id"]).where("predicted = 1").collect()}
    a = keep(stage["toxicity"](spark, docs, SF))
    assert {r.doc_id for r in a.collect()} == {r.doc_id for r in docs.collect()} - toxic
    b = keep(stage["ngram_jaccard_join"](spark, a, SF))
    rows = sorted((r.doc_id, r.text) for r in a.collect())
    sets = [set(shingle_set(t, 5).tolist()) for _, t in rows]
    group = groups(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])])
    assert {r.doc_id for r in b.collect()} == {rows[k][0] for k in range(len(rows)) if group[k] == k}
    c = keep(stage["pii_surrogates"](spark, b, SF))
    assert {r.doc_id for r in c.collect()} == {r.doc_id for r in b.collect()} and all(r.n_chars == len(r.text) for r in c.collect())
    d = keep(stage["source_mixing"](spark, c, SF))
    taken = {r.doc_id: r.taken for r in mixing.mix(c, corpus_pipeline.WEIGHTS).collect()}
    got = Counter()
    for r in d.collect():
        got[r.doc_id] += len(words(r.text))
    assert got == Counter({k: n for k, n in taken.items() if n})
    e = stage["packing"](spark, d, SF).collect()
    want = Counter()
    for r in d.collect():
        want[r.doc_id] += len(packing.token_bytes([r.text], packing.default_vocabulary())[0]) // 4
    have = Counter()
    for r in e:
        have[r.doc_id] += r.length
    assert have == want


def test_columns(spark):
    assert registry.QUERIES["op9_mixing"](spark, SF).where(F.col("target").isNull()).count() == 0


# --- signature trees ----------------------------------------------------------------------------------------------------
def test_signature_tree_prunes_inner_nodes():
    """Disjoint sets, and sets that share less than it takes: few node pairs are met, and no leaf pair is decided."""
    rng = np.random.default_rng(0)
    some = lambda n: np.unique(rng.integers(0, (1 << 64) - 1, n, dtype=np.uint64))
    template = some(120)
    for sets in ([some(50) for _ in range(1500)], [np.union1d(template, some(50)) for _ in range(1500)]):
        seen = {}
        assert signature_tree.linked(sets, None, 85, 100, seen=seen) == []
        assert seen.get("leaves", 0) == 0 and seen["nodes"] < 1500 * 1499 / 2 / 10


def test_signature_tree_brute_force():
    rng = np.random.default_rng(1)
    pool = [np.unique(rng.integers(0, 1 << 40, n, dtype=np.uint64)) for n in (3, 20, 21, 60, 300)]
    sets = [np.unique(np.concatenate([p[rng.random(len(p)) > 0.06], rng.integers(0, 1 << 40, len(p) // 15, dtype=np.uint64)])) for p in pool for _ in range(30)]
    sets = [s for s in sets if len(s)]
    link = [(i, j) for i in range(len(sets)) for j in range(i) if signature_tree.similar(sets[i], sets[j], 80, 100)]
    want = groups(len(sets), link)
    cut = len(sets) // 3
    both = [(x, y) for x, y in signature_tree.linked(sets[:cut], sets[cut:], 80, 100)]
    inner = signature_tree.linked(sets[:cut], None, 80, 100) + [(cut + x, cut + y) for x, y in signature_tree.linked(sets[cut:], None, 80, 100)]
    assert groups(len(sets), signature_tree.linked(sets, None, 80, 100)) == groups(len(sets), both + inner) == want
    known = np.array(groups(len(sets), inner))
    after = signature_tree.linked(sets[:cut], sets[cut:], 80, 100, known)
    assert groups(len(sets), inner + after) == want and len(after) <= len(both)
    assert 10 < len(set(want)) < len(sets) - 10


def test_hubs(spark):
    edges = [(0, k) for k in range(1, 300)] + [(k, 900) for k in range(500, 700)] + [(700, 701), (701, 702)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    assert got == {k: 0 for k in range(300)} | {k: 500 for k in [*range(500, 700), 900]} | {k: 700 for k in (700, 701, 702)}


def test_one_template_is_no_cluster(spark):
    """Lines of one template whose own words make them differ: no two share a prefix shingle that counts, so none is read again."""
    rows = [(k, f"dear customer {k}a your order {k}b of the {k}c day has been sent to {k}d and should reach you soon {k}e") for k in range(400)]
    got = jaccard_join.join_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(k, k) for k in range(400)}
