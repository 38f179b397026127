"""The contracts of the queries against brute force over whole small tables, and the cases that the docstrings state."""

from __future__ import annotations

import base64
import difflib
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from eventloom.llm import queries
from eventloom.llm.bpe import decode_documents, encode_documents
from eventloom.llm.common import tokenizer_path
from eventloom.llm.line_dedup import dedup_lines
from eventloom.llm.media import decode_png, encode_png, to_media
from eventloom.llm.near_dups import drop_near_duplicates, near_duplicates
from eventloom.llm.packing import pack_sequences
from eventloom.llm.pii import detect, redact
from eventloom.llm.quality_gam import classify, reject_low_quality
from eventloom.llm.quality_rules import quality_rules
from eventloom.llm.secrets import scan
from eventloom.llm.toxicity import fit_toxicity, score_toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, label string"
LONG = " ".join(f"word{i % 977}" for i in range(60_000))
HARD = [
    (1, None, None, None, None, None, None),
    (2, "", "en", "a", 0, 1, "x"),
    (3, "  \n\t\n", None, "a", 3, None, None),
    (4, LONG, "en", "a", len(LONG), 2, "y"),
    (5, "naïve 😀 text\x00 with odd characters   in it", "en", "a", 40, 3, None),
    (6, "same text " * 30, "en", "a", 300, 3, "z"),
    (6, "same text " * 30, "en", "a", 300, 3, "z"),
    (7, "same text " * 30, "en", "a", 300, 3, "z"),
    (None, "a row without an id", "en", "b", 19, 4, None),
]
LABELS = [(2, 0, 1), (4, 1, 0), (6, None, None), (7, 1, 0), (None, 1, 1)]


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


def result(spark, sf_dir, name):
    return {r["doc_id"]: r for r in queries.QUERIES[name](spark, sf_dir).collect()}


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def test_quality_rules(spark, sf_dir, texts):
    got = result(spark, sf_dir, "op1_quality_rules")
    assert set(got) == set(texts)
    for i, t in texts.items():
        words = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        at = defaultdict(list)
        for k in range(len(words) - 7):
            at[tuple(words[k : k + 8])].append(k)
        repeated = {k + j for ks in at.values() if len(ks) > 1 for k in ks for j in range(8)}
        failed = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeated), failed)
        assert not (failed and r.kept)


def jaccard(a: str, b: str) -> float:
    def bag(t):
        w = WORD.findall(t.lower())
        return Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])

    a, b = bag(a), bag(b)
    least = (a & b).total()
    return least / (a.total() + b.total() - least)


def test_near_duplicates(spark, sf_dir, texts):
    got = {i: r.class_id for i, r in result(spark, sf_dir, "op2_bagminhash_near_dups").items()}
    top = {i: i for i in texts}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if jaccard(texts[i], texts[j]) >= 0.8:
                a, b = sorted((root(i), root(j)))
                top[b] = a
    assert got == {i: root(i) for i in ids}


def test_fuzzy_lines(spark):
    line = "the quick brown fox jumps over the lazy dog near the old river bank today with seven friends and two cats"
    near = line.replace("today", "todays")
    other = "a wholly different sentence that talks about trains, stations, timetables and the long way back home"
    docs = spark.createDataFrame([(1, f"{line}\nshort\nshort"), (2, f"{other}\n{line.upper()}"), (3, near), (4, None), (5, f"{other}\n{other}")], "doc_id long, text string")
    got = {r.doc_id: r for r in dedup_lines(docs).collect()}
    assert got[1].text == f"{line}\nshort\nshort" and got[2].text == other and got[4].text is None and got[5].text == "" and got[5].removed_lines == [0, 1]
    assert difflib.SequenceMatcher(None, line, near).ratio() > 0.9
    assert got[3].removed_lines in ([], [0])  # SimHash joins it or not; edit similarity alone does not


@pytest.mark.parametrize(("name", "folds", "out", "label"), [("op4_nearest_toxicity", 3, 1, "toxic"), ("op8_gam_quality", 4, 2, "quality")])
def test_scores_of_held_out_rows(spark, name, folds, out, label):
    sf_dir = "/root/testdata/sf0.01"
    got = result(spark, sf_dir, name)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % folds == out) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in got.items())
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    pairs = [(got[i].score, y) for i, y in truth.items() if i in got and got[i].held_out and y is not None]
    good, bad = [s for s, y in pairs if y == 1], [s for s, y in pairs if y == 0]
    wins = sum((a > b) + (a == b) / 2 for a in good for b in bad)
    assert wins / (len(good) * len(bad)) >= 0.85


def test_packing(spark, sf_dir, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    ids = {i: [*t.encode(x, add_special_tokens=False).ids, 1] for i, x in texts.items()}
    pieces = queries.QUERIES["op5_cost_balanced_packing"](spark, sf_dir).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        part = ids[p.doc_id][p.start : p.start + p.length]
        assert p.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)) and p.doc_tokens == len(ids[p.doc_id])
        by_doc[p.doc_id].append((p.start, p.length))
        by_seq[p.sequence_id].append((p.offset, p.length))
    for covered, total in [(v, len(ids[k])) for k, v in by_doc.items()] + [(v, None) for v in by_seq.values()]:
        at = 0
        for start, n in sorted(covered):
            assert start == at and n > 0
            at += n
        assert at == total if total else at <= 2048
    assert set(by_doc) == set(ids)
    assert len(by_seq) <= -(-sum(map(len, ids.values())) // 2048) + 8  # one unfilled sequence a group


def test_byte_bpe(spark, sf_dir, texts):
    import public_tokenizers
    import tiktoken

    with open(tokenizer_path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, r in result(spark, sf_dir, "op6_byte_bpe").items():
        ids = own.encode_ordinary(texts[i])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(texts[i]))
    hard = spark.createDataFrame(HARD, SCHEMA).where("doc_id in (1, 2, 3, 5)")
    assert decode_documents(encode_documents(hard)).count() == 4


def test_secrets(spark, sf_dir, texts):
    assign = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for i, r in result(spark, sf_dir, "op7_markov_secret_scan").items():
        t = texts[i]
        found = [[(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 12], [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18], [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16]]
        spans = [f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(sum(found, []))]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(map(len, found)) and r.base_sha256 == sha(",".join(spans))
        assert set(spans) <= set(r.spans.split(",")) or not spans


def test_media(spark, sf_dir, texts):
    for i, r in result(spark, sf_dir, "op9_media_columns").items():
        raw = texts[i].encode()
        payload = raw + bytes(64 - len(raw) % 64 if len(raw) % 64 or not raw else 0)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), sha(payload), zlib.crc32(payload[-64:]))
    data = encode_png(bytes(range(256)) * 4)
    assert decode_png(data).tobytes()[:1024] == bytes(range(256)) * 4
    with pytest.raises(ValueError):
        decode_png(data[:60] + bytes([data[60] ^ 1]) + data[61:])


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(digits[::-1])) % 10 == 0


def test_personal_data(spark, sf_dir, texts):
    only = lambda x: re.sub("[^0-9]", "", x)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda x: 16 <= len(only(x)) <= 19 and luhn(only(x))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 8 <= len(only(x)) <= 15),
    }
    for i, r in result(spark, sf_dir, "op10_bootstrapped_pii").items():
        found = {k: [f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, texts[i]) if good(m[0])] for k, (p, good) in kinds.items()}
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(map(len, found.values()))
        assert r.base_sha256 == sha(",".join(sum(found.values(), [])))


def test_context_finds_unseen_identifiers(spark):
    rows = [(i, f"please write to user{i}@example.org now") for i in range(40)] + [(99, "please write to member-48213 now"), (98, "chapter member-48213x of 12 books")]
    got = {r.doc_id: r for r in detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(x.s, x.e) for x in got[99].extra] == [(16, 28)] and not got[98].extra
    assert redact(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 99").first().text == "please write to [context] now"


OPERATORS = {
    "quality_rules": lambda d, s: quality_rules(d, s),
    "near_duplicates": lambda d, s: near_duplicates(d),
    "drop_near_duplicates": lambda d, s: drop_near_duplicates(d),
    "dedup_lines": lambda d, s: dedup_lines(d),
    "toxicity": lambda d, s: score_toxicity(d, fit_toxicity(d, s)),
    "pack_sequences": lambda d, s: pack_sequences(d),
    "byte_bpe": lambda d, s: encode_documents(d),
    "secrets": lambda d, s: scan(d),
    "classify": lambda d, s: classify(d, s),
    "reject_low_quality": lambda d, s: reject_low_quality(d, s),
    "media": lambda d, s: to_media(d),
    "personal_data": lambda d, s: detect(d),
    "redact": lambda d, s: redact(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_hard_rows_and_empty_tables(spark, name):
    docs = spark.createDataFrame(HARD, SCHEMA)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = OPERATORS[name](docs, labels).collect()
    expected = {"near_duplicates": 7, "drop_near_duplicates": None, "reject_low_quality": None, "pack_sequences": None}
    if (n := expected.get(name, len(HARD))) is not None:
        assert len(got) == n
    if name == "near_duplicates":
        of = {r.doc_id: r.class_id for r in got}
        assert of[7] == of[6] == 6 and of[1] == 1 and of[2] == of[3] == 2
    assert OPERATORS[name](docs.where("false"), labels).collect() == []
    assert OPERATORS[name](docs.where("false"), labels.where("false")).collect() == []


def test_pipeline_stages(spark, sf_dir, texts):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == names, name
        assert docs.count() <= before
    kept = {r.doc_id for r in docs.select("doc_id").collect()}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == kept
    label = near_duplicates(docs).groupBy("class_id").agg(F.count("*").alias("n")).where("n > 1").count()
    assert label <= len(kept) // 20
    assert len(kept) > len(texts) // 4


def test_line_simhash(spark):
    """SimHashes by blocks against votes counted one by one, with lane sums and with a sum for each bit."""
    from eventloom.llm.line_dedup import BLOCKS, WIDTH, line_features, lines_of

    texts = [" ".join(f"w{i % 97}" for i in range(300)), " ".join(f"w{i * i % 1013}" for i in range(20000)), "a b\tc  d e f\n\nshort", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lines = lines_of(docs, 5).withColumn("rid", F.xxhash64("doc_id", "raw", "line")).cache()
    hashes = {r["h1"]: [x % 2**64 for x in r["hs"]] for r in lines.select("h1", F.transform(F.split("t", " "), lambda w: F.xxhash64(w)).alias("hs")).collect()}
    assert sorted(map(len, hashes.values())) == [6, 300, 20000]
    want = {}
    for k, hs in hashes.items():
        of = [[x for x in hs if x >> 62 == b] for b in range(BLOCKS)]
        want[k] = sum(1 << p for p in range(64) if 2 * sum(x >> p & 1 for x in of[p // WIDTH]) > len(of[p // WIDTH]))
    for wide in (False, True):
        assert {r["h1"]: r["sim"] % 2**64 for r in line_features(lines, wide).collect()} == want


@pytest.mark.parametrize("words", [8, 12, 20, 40, 80])
def test_one_word_edits_of_lines_are_found(spark, words):
    import random

    rng = random.Random(words)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 8)))
    rows = []
    for k in range(50):
        line = [word() for _ in range(words)]
        other = list(line)
        other[rng.randrange(words)] = word()
        rows += [(2 * k, " ".join(line)), (2 * k + 1, " ".join(other))]
    got = {r.doc_id: r.removed_lines for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}

    def similarity(a, b):
        last = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            now = [i]
            for j, y in enumerate(b, 1):
                now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
            last = now
        return 1 - last[-1] / max(len(a), len(b))

    near = [similarity(rows[2 * k][1], rows[2 * k + 1][1]) >= 0.8 for k in range(50)]
    found = [got[2 * k + 1] == [0] for k in range(50)]
    assert not any(f and not n for f, n in zip(found, near, strict=True))
    assert sum(found) >= 0.9 * sum(near)


def test_a_group_of_edited_copies_without_their_original(spark):
    """Classes equal those of all pairs, where most pairs of the group are not similar enough."""
    import random

    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    texts = {}
    for i in range(120):
        w = list(base)
        for at in rng.sample(range(150), 3):
            w[at] = f"x{rng.randrange(10**6)}"
        texts[i] = " ".join(w)
    top = {i: i for i in texts}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    true = 0
    for i in texts:
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                true += 1
                a, b = sorted((root(i), root(j)))
                top[b] = a
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert 0 < true < 120 * 119 // 4 and got == {i: root(i) for i in texts}


def test_rows_without_or_with_repeated_ids(spark):
    """Rows are judged by their own texts: nothing of another row's text is removed, and no personal data stays."""
    rows = [(None, "mail joe@example.org now"), (5, "aaaaaaaaaa and more words here"), (5, "to joe@example.org and back"), (None, "mail ann@example.org now"), (7, "one two three four five six\nseven eight nine ten eleven twelve"), (7, "other words that stand alone here\nseven eight nine ten eleven twelve")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.text for r in redact(docs).collect()) == sorted(re.sub(r"\w+@example.org", "[email]", t) for _, t in rows)
    lines = {(r.doc_id, r.text, tuple(r.removed_lines)) for r in dedup_lines(docs).collect()}
    assert len(lines) == 6 and sum(len(x[2]) for x in lines) == 1
    tied = spark.createDataFrame([(None, "alpha beta gamma"), (3, "delta beta gamma"), (None, "gamma beta gamma")], "doc_id long, text string")
    assert len({(r.doc_id, r.doc_tokens, r.offset) for r in pack_sequences(tied.coalesce(1)).collect()}) == 3
    copies = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (2, "x y z"), (2, "x y z"), (3, "x y z")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in drop_near_duplicates(copies).collect()) == [(0, "a b c d e f"), (2, "x y z")]


def test_random_strings_are_told_from_identifiers(spark):
    import random
    import string

    rng = random.Random(11)
    secrets = ["".join(rng.choice(a) for _ in range(rng.randint(16, 40))) for a in (string.ascii_letters + string.digits, string.ascii_lowercase + string.digits, string.ascii_uppercase + "234567", string.ascii_letters + string.digits + "+/") for _ in range(75)]
    parts = "fetch remote customer ledger balance compute weighted average shipping rate normalise unicode string legacy parser tokens open archive member reader".split()
    plain = ["_".join(rng.sample(parts, 4)) for _ in range(100)] + ["".join(x.capitalize() for x in rng.sample(parts, 4)) for _ in range(100)] + ["/".join(rng.sample(parts, 4)) for _ in range(100)]
    docs = spark.createDataFrame([(i, f"value is {s} there") for i, s in enumerate(secrets + plain)], "doc_id long, text string")
    found = {r.doc_id for r in scan(docs).collect() if r.extra or r.base}
    assert len([i for i in found if i < 300]) >= 270 and len([i for i in found if i < 300]) >= 0.9 * len(found)


def test_contexts_have_recall_and_precision(spark):
    import random

    rng = random.Random(2)
    word = lambda: rng.choice("alpha river stone window garden letter simple motor".split())
    rows = [(i, f"{word()} {word()} reach me at user{i}@mail{i % 7}.example.org thanks {word()}") for i in range(60)]
    ids = {100 + i: f"ACC-{rng.randrange(10**7, 10**8)}" + "0" * (i % 2) * 70 for i in range(50)}
    rows += [(k, f"{word()} reach me at {v} thanks {word()}") for k, v in ids.items()]
    rows += [(200 + i, f"{word()} {word()} part {rng.randrange(10**5, 10**6)}-{i} of the {word()}") for i in range(50)]
    got = {r.doc_id: r.extra for r in detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = dict(rows)
    hits = {k for k in ids if any(text[k][x.s : x.e] == ids[k] for x in got[k])}
    assert len(hits) >= 45 and sum(len(x) for x in got.values()) <= len(hits) / 0.9


def test_toxicity_neighbours_are_those_of_all_cosines(spark):
    import math

    from eventloom.llm.toxicity import tokens

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = fit_toxicity(docs, labels, k=5)
    texts = {r.doc_id: r.text for r in docs.collect()}
    bags = {i: tokens(texts[i]) for i in model.index.doc_ids.tolist()}
    n, df = len(bags), Counter(w for b in bags.values() for w in b)

    def vector(bag):
        v = {w: (1 + math.log(c)) * (math.log((n + 1) / (df[w] + 1)) + 1) for w, c in bag.items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1
        return {w: x / norm for w, x in v.items()}

    known = [vector(b) for b in bags.values()]
    for t in list(texts.values())[:60]:
        q = vector(tokens(t))
        all_ = sorted((-round(sum(x * v.get(w, 0) for w, x in q.items()), 9), k) for k, v in enumerate(known))[:5]
        ids, cosines = model.index.nearest(model.index.vector(t), 5)
        assert [-s for s, _ in all_ if s < 0] == pytest.approx(cosines.tolist(), abs=1e-7)


def test_bin_tables_add_up(spark):
    import numpy as np

    from eventloom.llm.quality_gam import fit_gam

    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float)
    model = fit_gam(x, y)
    for row in x[:50]:
        bins = [int(np.searchsorted(e, v, side="right")) for e, v in zip(model.edges, row, strict=True)]
        total = model.intercept + sum(t[b] for t, b in zip(model.tables, bins, strict=True)) + sum(t[model.coarse[i][bins[i]], model.coarse[j][bins[j]]] for (i, j), t in model.pairs.items())
        assert abs(model.score(row[None, :])[0] - 1 / (1 + np.exp(-total))) < 1e-9
    assert np.mean((model.score(x) > 0.5) == y) > 0.9


def test_ratio_of_quality_rules(spark):
    """The score is the mean log ratio of hashed unigrams and bigrams, counted here one by one."""
    import math

    from eventloom.llm.quality_rules import fit_ratio

    rows = [(1, "a b a c"), (2, "a c c"), (3, None), (4, "d e f a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    trusted = docs.where("doc_id in (1, 4)")
    ratio = fit_ratio(docs, trusted, buckets=64)
    hash_ = {w: spark.sql(f"select xxhash64('{w}') h").first().h for w in "abcdef"}

    def grams(t):
        w = (t or "").split()
        pairs = [spark.sql(f"select pmod(xxhash64({hash_[x]}L, {hash_[y]}L), 64) h").first().h for x, y in zip(w, w[1:], strict=False)]
        return [hash_[x] % 64 for x in w] + pairs

    raw, target = Counter(g for _, t in rows for g in grams(t)), Counter(g for i, t in rows if i in (1, 4) for g in grams(t))
    want = [math.log((target[b] + 1) / (target.total() + 64)) - math.log((raw[b] + 1) / (raw.total() + 64)) for b in range(64)]
    assert all(abs(a - b) < 1e-5 for a, b in zip(ratio, want, strict=True))


def test_ranks_above_the_surrogates(spark, tmp_path):
    import public_tokenizers
    import tiktoken

    with open(tokenizer_path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) + (30_000 if int(b) >= 256 else 0) for a, b in map(bytes.split, f)}
    (tmp_path / "ranks").write_bytes(b"".join(base64.b64encode(k) + b" %d\n" % v for k, v in ranks.items()))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {1: "a" * 3000 + " and unbelievably " + "xyz" * 400, 2: "naïve 😀 text " * 30, 3: None, 4: "\x1e marked \x1e"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    for r in encode_documents(docs, vocabulary=str(tmp_path / "ranks"), block_bytes=400, most_pieces=10).collect():
        assert r.ids == own.encode_ordinary(texts[r.doc_id] or "")


def test_changed_words_of_lines_are_found(spark):
    """Recall of planted pairs whose edit similarity is 0.8 or more; SimHash alone misses nearly all of them."""
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 8)))
    rows, planted = [], 0
    for n in (6, 8, 10, 15, 20, 30, 40) * 5:
        line = [word() for _ in range(n)]
        other = list(line)
        for at in rng.sample(range(n), max(1, n // 10)):
            other[at] = other[at][1:] + "x"
        rows += [(2 * planted, " ".join(line)), (2 * planted + 1, " ".join(other))]
        planted += 1
    got = {r.doc_id: r.removed_lines for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[2 * k] == [] for k in range(planted))
    assert sum(got[2 * k + 1] == [0] for k in range(planted)) == planted


def test_short_lines_of_the_query_and_the_pipeline(spark, tmp_path):
    """Repeats of lines of one to four words go, exact or fuzzy; blank lines stay."""
    lines = corpus_pipeline.lines
    rows = [(1, "All rights reserved.\n\nles.\nsomething else"), (2, "ALL  rights reserved.\n\n\nles.\nno copy"), (3, "all right reserved."), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.removed_lines for r in queries.QUERIES["op3_fuzzy_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == {1: "", 2: "0,3", 3: "0", 4: ""}
    assert {r.doc_id: r.text for r in lines(spark, docs, str(tmp_path)).collect()} == {1: rows[0][1], 2: "\n\nno copy", 3: "", 4: None}


def test_toxicity_compares_whole_texts(spark):
    """Neighbours and cosines are those of all words, also of words that no example has."""
    import math

    texts = {i: f"word{chr(97 + i % 26)}{chr(97 + i // 26)} common {'vile' if i == 7 else 'plain'} text" for i in range(200)}
    docs = spark.createDataFrame([*texts.items(), (500, texts[7]), (501, texts[8] + " neverseen"), (502, "nothing")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i == 7)) for i in texts], "doc_id long, toxic int")
    got = {r.doc_id: r for r in score_toxicity(docs, fit_toxicity(docs, labels)).collect()}
    assert got[500].evidence[0] == 7 and got[500].cosines[0] == 1
    idf = lambda df: math.log(201 / (df + 1)) + 1
    square = idf(1) ** 2 + 2 * idf(200) ** 2 + idf(199) ** 2
    assert got[501].evidence[0] == 8 and abs(got[501].cosines[0] - math.sqrt(square / (square + idf(0) ** 2))) < 1e-6
    assert got[502].evidence == []


def test_a_few_insults_in_a_long_text_are_found(spark, tmp_path):
    """Inflected insults, no whole word of which occurs twice, decide on the score of unseen long texts."""
    rng = random.Random(4)
    plain = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7))) for _ in range(2000)]
    insult = lambda: "vequ" + "".join(rng.choice("bcdfgk") for _ in range(6))
    rows, truth = [], []
    for i in range(900):
        toxic = int(i % 6 == 0)
        words = rng.choices(plain, k=300)
        for _ in range(3 * toxic):
            words[rng.randrange(300)] = insult()
        rows.append((i, " ".join(words)))
        truth.append((i, toxic))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(truth, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = [r for r in queries.QUERIES["op4_nearest_toxicity"](spark, str(tmp_path)).collect() if r.held_out]
    caught = [r.predicted for r in got if truth[r.doc_id][1]]
    wrong = [r.predicted for r in got if not truth[r.doc_id][1]]
    assert len(caught) > 30 and sum(caught) >= 0.95 * len(caught) and sum(wrong) <= 0.02 * len(wrong)


def test_lines_that_share_a_very_common_key_alone(spark):
    """Pairs of a large key are all found, also where they are like no centre of it."""
    from eventloom.llm.common import Scratch
    from eventloom.llm.groups import linked
    from eventloom.llm.line_dedup import FEW_LINES, verifier

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5))
    lines = []
    for k in range(40):
        line = [word() for _ in range(8)]
        lines += [(2 * k, " ".join(line)), (2 * k + 1, " ".join([*line[:7], word()]))]
    table = spark.createDataFrame(lines, "h1 long, t string")
    sizes = table.select(F.col("h1").alias("node"), F.struct(F.length("t").alias("size"), F.lit(None).cast("long").alias("sim")).alias("size"))
    with Scratch(spark) as scratch:
        found = linked(table.select(F.lit(1).cast("long").alias("key"), F.col("h1").alias("node")), sizes, *verifier(table, 0.8), scratch, FEW_LINES)
        of = {r.node: r.label for r in found.collect()}
    assert len(of) == 80 and all(of[2 * k] == of[2 * k + 1] for k in range(40)) and len(set(of.values())) == 40


def test_edit_similarity_of_lines_is_exact(spark):
    """Short ways to a decision agree with the distance itself, for close, middling and unlike texts."""
    from eventloom.llm.line_dedup import near

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("etaonhrdlé") for _ in range(rng.randint(1, 9)))
    rows = []
    for _ in range(300):
        line = [word() for _ in range(rng.choice([1, 4, 12, 50, 150]))]
        other = list(line)
        for _ in range(int(len(line) * rng.choice([0, 0.1, 0.2, 0.25, 0.3, 1])) + rng.randint(0, 1)):
            at = rng.randrange(len(other) + 1)
            other[at : at + rng.randint(0, 1)] = [word()] * rng.randint(0, 1)
        rows.append((" ".join(line), " ".join(other)))
    pairs = spark.createDataFrame(rows, "ta string, tb string")
    want = sorted(map(tuple, pairs.where(F.levenshtein("ta", "tb") <= F.floor(F.greatest(F.length("ta"), F.length("tb")) * (1 - 0.8) + 1e-9)).collect()))
    assert 50 < len(want) < 280 and sorted(map(tuple, near(pairs, 0.8).collect())) == want


def test_pairs_of_a_large_key_grow_with_its_lines(spark):
    """Lines around a common passage: similar ones are linked, without all pairs of the unlike ones."""
    from eventloom.llm.common import Scratch
    from eventloom.llm.groups import linked
    from eventloom.llm.line_dedup import FEW_LINES, verifier

    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5))
    passage, lines = [word() for _ in range(10)], []
    for k in range(800):
        line = [*(word() for _ in range(15)), *passage, *(word() for _ in range(15))]
        other = list(line)
        other[3], other[33] = word(), word()
        lines += [(2 * k, " ".join(line)), (2 * k + 1, " ".join(other))]
    table = spark.createDataFrame(lines, "h1 long, t string")
    sizes = table.select(F.col("h1").alias("node"), F.struct(F.length("t").alias("size"), F.lit(0).cast("long").alias("sim")).alias("size"))
    keyed = table.select(F.lit(1).cast("long").alias("key"), F.col("h1").alias("node"))
    with Scratch(spark) as scratch:
        of = {r.node: r.label for r in linked(keyed, sizes, *verifier(table, 0.8), scratch, FEW_LINES).collect()}
        assert len(of) == 1600 and all(of[2 * k] == of[2 * k + 1] for k in range(800)) and len(set(of.values())) == 800
        _, _, prepare, rest = verifier(table, 0.8)
        test = prepare(sizes.select("node"), scratch)
        pairs = rest(keyed.join(sizes, "node").select("key", "node", "size", F.col("node").alias("label")), test, scratch)
        assert 800 <= pairs.count() <= 100 * 1600  # all pairs: 1,279,200


def test_one_pair_merges_to_each_token():
    """Merges of the pairs of merge_pairs alone give the ids of merges of all pairs that are tokens, with odd vocabularies too."""
    from eventloom.llm.bpe import merge_pairs

    def merged(text, rank):
        parts = [text[i : i + 1] for i in range(len(text))]
        while found := [(r, i) for i in range(len(parts) - 1) if (r := rank(parts[i], parts[i + 1])) is not None]:
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    rng = random.Random(7)
    some = lambda n: bytes(rng.choice(b"abc") for _ in range(n))
    for _ in range(40):
        longer = sorted({some(rng.randint(2, 6)) for _ in range(rng.randint(5, 60))})
        rng.shuffle(longer)
        ranks = {t: r for r, t in enumerate([b"a", b"b", b"c", *longer])}
        pairs = merge_pairs(ranks)
        assert len(set(pairs.values())) == len(pairs) <= len(longer)
        for _ in range(40):
            text = some(rng.randint(1, 20))
            assert merged(text, lambda a, b, r=ranks: r.get(a + b)) == merged(text, lambda a, b, p=pairs, r=ranks: r.get(p.get((a, b))))
