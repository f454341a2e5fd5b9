"""The methods of the operators against plain versions of them, written another way."""

import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from test_edges import best_fit

from emberline.llm import dac, exact_dedup, language, packing, quality, queries, rules, sharding, warc

M32, M64 = 2**32 - 1, 2**64 - 1


def feistel(x, n, key, rounds=4):
    half = max(1, -(-max(n - 1, 1).bit_length() // 2))

    def mixed(v, r):
        v = (v + key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & M64
        v = (v ^ v >> 30) * 0xBF58476D1CE4E5B9 & M64
        v = (v ^ v >> 27) * 0x94D049BB133111EB & M64
        return v ^ v >> 31

    while True:
        a, b = x >> half, x & (1 << half) - 1
        for r in range(rounds):
            a, b = b, a ^ mixed(b, r) & (1 << half) - 1
        x = a << half | b
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 5, 100, 1025])
def test_feistel(n):
    assert sharding.permute(np.arange(n), n, 42).tolist() == [feistel(x, n, 42) for x in range(n)]


@pytest.mark.parametrize(("least", "most"), [(300, 2048), (1, 2048), (200, 700), (600, 1100), (500, 1000)])
def test_packing_against_best_fit(least, most):
    rng = random.Random(least)
    for n in (100, 3000, 20000):
        lengths = [rng.randint(least, most) for _ in range(n)]
        made = packing.plan(dict(Counter(lengths)), 2048)
        back = Counter()
        for pattern, times in made:
            assert sum(pattern) <= 2048
            for x in pattern:
                back[x] += times
        assert back == Counter(lengths)
        assert sum(t for _, t in made) <= best_fit(lengths, 2048)


def test_sums_index_counts_what_is_there():
    rng = random.Random(1)
    sums = packing._Sums(np.array([0, *[rng.choice([0, 1, 2, 5]) for _ in range(40)]]))
    while sums.left.any():
        there = np.flatnonzero(sums.left).tolist()
        pairs = Counter(a + b for a in there for b in there if a <= b)
        triples = Counter(a + b + c for a in there for b in there for c in there if a <= b <= c)
        assert sums.singles.tolist() == (sums.left > 0).astype(int).tolist()
        assert sums.pairs.tolist() == [pairs[s] for s in range(41)] and sums.triples.tolist() == [triples[s] for s in range(41)]
        x = rng.choice(there)
        sums.take((x,), 1)


def test_ranges_of_token_files():
    rng = np.random.default_rng(2)
    for n in (0, 1, 511, 512, 513, 3000):
        ids = rng.integers(0, 1 << 32, n).astype(np.uint32) >> rng.integers(0, 32, n).astype(np.uint32)
        f = dac.DacFile(dac.encode_file([1], [n], ids))
        ends = [sorted(rng.integers(0, n + 1, 2).tolist()) for _ in range(50)] + [[0, n], [n, n], [0, 0]]
        assert all(f.between(a, b).tolist() == ids[a:b].tolist() for a, b in ends)
    with pytest.raises(IndexError):
        f.between(0, n + 1)


def bucket(gram):
    h = None
    for k, c in enumerate(gram):
        h = ord(c) * 2654435761 & M32 if h is None else (h ^ ord(c)) * (2246822519 + 2 * k) & M32
        h ^= h >> 15 if k else 0
    return h % language.BUCKETS


def grams(text):
    text = text.lower()
    return [bucket((text + "\0\0")[i : i + 3]) for i in range(len(text))]


def test_naive_bayes(spark, sf_dir):
    docs = [r for r in duckdb.sql(f"SELECT doc_id, text, lang FROM '{sf_dir}/documents.parquet' WHERE text IS NOT NULL AND lang IS NOT NULL ORDER BY doc_id").fetchall() if len(r[1]) < 3000][:60]
    counts, held = defaultdict(Counter), {d for d, _, _ in docs if d % 4 == 0}
    for d, text, lang in docs:
        if d not in held:
            counts[lang].update(grams(text))
    total = {g: sum(n.values()) + 0.5 * language.BUCKETS for g, n in counts.items()}
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language.identify(frame, held_out=F.col("doc_id") % 4 == 0).collect()}
    for d, text, _ in docs:
        own = grams(text)
        log = {g: sum(math.log((n[b] + 0.5) / total[g]) for b in own) for g, n in counts.items()}
        first, second = sorted(log, key=log.get, reverse=True)[:2]
        assert got[d]["lang_pred"] == first and got[d]["n_grams"] == len(own)
        assert got[d]["margin"] == pytest.approx((log[first] - log[second]) / len(own), abs=1e-3)
        assert got[d]["score"] == pytest.approx(1 / sum(math.exp(v - log[first]) for v in log.values()), abs=1e-3)


def test_sampling_rows_of_one_id(spark):
    """Where every row has the same id, the sample is still a sample, by the texts."""
    docs = spark.range(3000).select(F.lit(7).alias("doc_id"), F.concat(F.lit("the word "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    assert language.learn(docs, F.lit(True), most=300).languages == ["en"]


def plain_features(text):
    data = text.encode()
    n, words, lines = max(1, len(data)), data.split(), [x for x in data.split(b"\n") if x.strip()]
    w = max(1, len(words))
    of = lambda chars: sum(b in chars.encode() for b in data) / n
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    symbols, stops, shouts = "#*$%&|<>{}[]~^\\=_+@/", ".,;:'\"-()", "!?"
    beyond = sum(b > 127 for b in data) / n
    known = upper + lower + digits + symbols + stops + shouts + "\t\n\x0b\x0c\r "
    other = sum(b < 128 and chr(b) not in known for b in data) / n
    most = max(Counter(words).values(), default=0)
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [math.log1p(len(data)), math.log1p(len(words)), sum(map(len, words)) / w, len(set(words)) / w, of(upper), of(digits), of(symbols), of(stops), of(shouts), other, beyond, 1 - len(set(lines)) / max(1, len(lines)), len(words) / max(1, len(lines)), most / w, again / w, of(upper) + of(lower) + beyond]


def test_additive_model(spark, sf_dir):
    texts = [t or "" for (t,) in duckdb.sql(f"SELECT text FROM '{sf_dir}/documents.parquet' ORDER BY doc_id LIMIT 60").fetchall()] + ["", "\x00~`é", "a a a\n\na a a"]
    x = np.array([quality.text_features(t.encode()) for t in texts])
    assert x == pytest.approx(np.array([plain_features(t) for t in texts]))
    rng = np.random.default_rng(3)
    model = quality.Gam(x, rng.integers(0, 2, len(x)), rounds=5, pair_rounds=3)
    for row, got in zip(x, model.score(x), strict=True):
        total = model.base + sum(t[sum(row[k] >= c for c in cuts)] for k, (cuts, t) in enumerate(zip(model.cuts, model.tables, strict=True)))
        total += sum(t[sum(row[a] >= c for c in model.coarse[a]), sum(row[b] >= c for c in model.coarse[b])] for a, b, t in model.pairs)
        assert got == pytest.approx(1 / (1 + math.exp(-total)))


def test_classifier_on_held_out_labels(spark):
    """Fitted on made-up labels; the smallest tables hold out hardly any of their own."""
    rng = random.Random(1)
    docs = [(d, " ".join(rng.choice(["some words of plain prose, and more of it.", "$$ ## %% BUY!! NOW!!"][d % 2 :][:1]) for _ in range(rng.randint(3, 30)))) for d in range(400)]
    labels = spark.createDataFrame([(d, 1 - d % 2, 0) for d in range(400)], "doc_id long, quality int, toxic int")
    got = quality.classify(spark.createDataFrame(docs, "doc_id long, text string"), labels).filter("held_out").collect()
    assert len(got) > 50 and all(r["predicted"] == 1 - r["doc_id"] % 2 for r in got)


def test_expectation_maximisation(spark):
    rng = random.Random(5)
    names = [r[0] for r in rules.RULES]
    votes = []
    for _ in range(400):
        good = rng.random() < 0.7
        votes.append(tuple((int(good) if rng.random() < 0.85 else int(not good)) if rng.random() < 0.5 else 2 for _ in names))
    prior, odds = rules.estimate(spark.createDataFrame(votes, ", ".join(f"{n} tinyint" for n in names)), rounds=10)

    good, bad, trust = rules.SEEN_GOOD, rules.SEEN_BAD, rules.TRUST
    p, ratio = good / (good + bad), [[-math.log(trust / (1 - trust)), math.log(trust / (1 - trust)), 0.0] for _ in names]
    for _ in range(10):
        post = [1 / (1 + math.exp(-(math.log(p / (1 - p)) + sum(ratio[r][x] for r, x in enumerate(v))))) for v in votes]
        p = (good + sum(post)) / (good + bad + len(votes))
        for r in range(len(names)):
            g = [good * share + sum(q for q, v in zip(post, votes, strict=True) if v[r] == k) for k, share in enumerate((1 - trust, trust, 0.1))]
            b = [bad * share + sum(1 - q for q, v in zip(post, votes, strict=True) if v[r] == k) for k, share in enumerate((trust, 1 - trust, 0.1))]
            ratio[r] = [math.log(g[k] / sum(g)) - math.log(b[k] / sum(b)) for k in range(3)]
    assert prior == pytest.approx(p)
    for name, own in zip(names, ratio, strict=True):
        assert odds[name] == pytest.approx(own)


def test_state_that_calls_share(spark, tmp_path):
    """A later call resumes the stream, meets the earlier digests and compares its bytes with texts that were kept then."""
    state, make = str(tmp_path / "state"), lambda rows: spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    read = lambda df: sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in df.collect())
    first = exact_dedup.exact_dedup(make([(5, "a b"), (6, "a  b"), (7, "c"), (8, None)]), state=state, files_per_trigger=1)
    assert read(first) == [(5, 5, 2, True), (6, 5, 2, False), (7, 7, 1, True), (8, 8, 1, True)]
    second = exact_dedup.exact_dedup(make([(1, "a\tb"), (2, "d"), (3, ""), (4, "d")]), carry=["text"], state=state)
    assert read(second) == [(1, 5, 3, False), (2, 2, 2, True), (3, 8, 2, False), (4, 2, 2, False)]
    assert {r["doc_id"]: r["text"] for r in second.collect()} == {1: "a\tb", 2: "d", 3: "", 4: "d"}
    third = exact_dedup.exact_dedup(make([(0, "d "), (9, "d")]), state=state)
    assert read(third) == [(0, 0, 1, True), (9, 2, 3, False)]
    assert read(exact_dedup.exact_dedup(make([]), state=state)) == []
    spark.read.parquet(f"{state}/kept").withColumn("norm", F.lit("forged")).write.parquet(f"{tmp_path}/forged")
    spark.read.parquet(f"{tmp_path}/forged").write.mode("overwrite").parquet(f"{state}/kept")
    with pytest.raises(ValueError, match="digest"):
        exact_dedup.exact_dedup(make([(10, "c")]), state=state)


def test_carried_columns_pass_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "x", "f", 9, "k"), (2, "x ", None, 8, "l"), (None, "x", "g", 7, "m")], "doc_id long, text string, file string, n long, digest string")
    got = exact_dedup.exact_dedup(docs, carry=["file", "n", "digest"]).collect()
    assert {(r["file"], r["n"], r["digest"], r["kept"]) for r in got} == {("f", 9, "k", True), (None, 8, "l", True), ("g", 7, "m", False)}


def test_damaged_and_stale_archives(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 400) for i in range(40)] + [(90, "long", "x" * 3_000_000)], "page_id long, url string, html string").coalesce(1)
    where = f"file://{tmp_path}/warc"
    warc.write_archives(warc.with_responses(pages), where, bytes_per_file=3000).write.parquet(f"{where}-list")
    files = sorted((tmp_path / "warc").glob("part-*"))
    assert len(files) > 2
    (tmp_path / "warc" / "part-000000-000000-999.warc.gz").write_bytes(files[0].read_bytes())  # of a lost attempt
    whole = warc.read_back(spark, where)
    assert sorted(r["page_id"] for r in whole.collect()) == [*range(40), 90]
    assert spark.read.parquet(f"{where}-quarantine").count() == 0
    assert warc.read_archives(spark, where).filter("kind = 'record'").count() > 41  # without a list, all that is there
    data = bytearray(files[1].read_bytes())
    data[40] ^= 0xFF
    files[1].write_bytes(bytes(data))
    listed = spark.read.parquet(f"{where}-list")
    found = warc.read_archives(spark, where, listed).collect()
    gaps = [r for r in found if r["kind"] == "gap"]
    assert len(gaps) == 1 and gaps[0]["archive"] == files[1].name and gaps[0]["from_byte"] == 0 and len(found) == 41
    other = f"file://{tmp_path}/again"
    listed.write.parquet(f"{other}-list")
    (tmp_path / "warc").rename(tmp_path / "again")
    with pytest.raises(ValueError, match="40 of 41"):
        warc.read_back(spark, other)
    assert [(r["archive"], r["from_byte"]) for r in spark.read.parquet(f"{other}-quarantine").collect()] == [(files[1].name, 0)]


def test_members_are_inflated_alone():
    """What follows a member is not read: many small members of one archive take time in proportion."""
    one = warc.member(warc.record(1, "u", b"p" * 500, warc.digest_of(b"p" * 500), None))
    assert sum(f[0] == "record" for f in warc.salvage(one * 20_000)) == 20_000


def test_pages_with_odd_columns(spark):
    assert queries.OP8_SQL
    pages = spark.createDataFrame([(1, None, None, "r"), (2, "u", "", "s"), (3, "u v", "é" * 700_000, "t")], "page_id long, url string, html string, name string")
    got = sorted(map(tuple, warc.archived(pages).select("page_id", "payload_bytes", "record_type", "refers_to").collect()))
    assert got == [(1, 0, "revisit", 2), (2, 0, "response", None), (3, 1_400_000, "response", None)]
