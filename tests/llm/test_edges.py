"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns; and what the methods promise."""

import bisect
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from emberline.llm import bpe, dac, exact_dedup, files, language, packing, quality, rules, sharding, simhash, tokens, warc
from emberline.llm.queries import BYTE_BPE, WORD_BPE

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, n long, fp long, words string, length long, row long, file string, held_out string, part int, root long"
LONG = "lang word " * 60_000


def odd(spark):
    tail = ("x", 1, 2, "w", 3, 4, "f", "h", 5, 6)
    data = [(1, None, None, None, None, *tail), (2, "", "en", "a", 0, *tail), (2, "", "en", "a", 0, *tail), (3, " \t\n ", "en", None, 1, *tail), (4, LONG, "en", "a", 9, *tail), (5, "the same text here", "en", "a", 9, *tail), (6, "the  same\ttext here", "fr", "a", 9, *tail), (None, "the same text here", "fr", None, None, *tail), (None, None, None, None, None, *tail), (7, "été <|endoftext|> it's\x1c 12½  x\n\n", "fr", "b", 3, *tail)]
    return spark.createDataFrame(data, SCHEMA)


def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (5, 0, 0), (6, 1, None), (None, 1, 1), (4, None, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "exact": lambda d: exact_dedup.exact_dedup(d),
    "shard": lambda d: sharding.shard_documents(d),
    "bpe": lambda d: bpe.encode_decode(d, WORD_BPE),
    "rules": lambda d: rules.judge(d),
    "pack": lambda d: packing.pack(d, WORD_BPE),
    "language": lambda d: language.identify(d),
    "dac": lambda d: dac.token_files(d, BYTE_BPE),
    "quality": lambda d: quality.classify(d, labels(d.sparkSession)),
    "simhash": lambda d: simhash.near_duplicates(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_empty_table(spark, name):
    docs = odd(spark)
    got = OPERATORS[name](docs).collect()
    ids = sorted((r["doc_id"] for r in got), key=str)
    if name == "pack":
        assert set(ids) == {None, 1, 2, 3, 4, 5, 6, 7}
    else:
        assert ids == sorted((r["doc_id"] for r in docs.collect()), key=str)
    empty = OPERATORS[name](docs.limit(0))
    assert empty.columns == OPERATORS[name](docs).columns
    assert empty.collect() == []


def test_exact_groups(spark):
    got = [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(odd(spark)).collect()]
    empty = [g for g in got if g[1] == 1]
    assert sorted(empty, key=str) == sorted([(1, 1, 4, True), (2, 1, 4, False), (2, 1, 4, False), (None, 1, 4, False)], key=str)
    assert sorted((g for g in got if g[1] == 5), key=str) == sorted([(5, 5, 3, True), (6, 5, 3, False), (None, 5, 3, False)], key=str)
    assert (3, 3, 1, True) in got  # one space isn't empty


def test_exact_dedup_checks_bytes(spark):
    """With digests of one byte, different texts meet in one state entry and are told apart by their bytes."""
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 700).cast("string")).alias("text"))
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs, digest_bytes=1).collect()}
    assert len(got) == 2000
    for d, r in got.items():
        assert (r["keep_id"], r["kept"], r["group_size"]) == (d % 700, d < 700, len(range(d % 700, 2000, 700)))


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 17, 1000, 4097):
        p = sharding.permute(np.arange(n), n, 7)
        assert sorted(p) == list(range(n))
        assert (sharding.permute(p, n, 7, inverse=True) == np.arange(n)).all()


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
def test_encoders_equal_the_library(path):
    rng = random.Random(1)
    t = Tokenizer.from_file(path)
    texts = [LONG, "", " ", "a<|endoftext|>b <|startoftext|>", "don't DON'T 'S", "x\x1cy\x85z\x01 w", "İstanbul ΟΔΟΣ ǅ", "日本語 123 ½ Ⅷ", "é ́a", "​﻿x"]
    texts += ["".join(rng.choice(a) for _ in range(30)) for a in ("abAB’ .<|>é\n İΣ́1", "abAB'’ .<|>é\n", "abc .,-_½²Ⅷ12 \t", "日本あ 1٣Ж ") for _ in range(300)]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert [x.tolist() for x in tokens.load(path).encode(texts)] == want
    if path == WORD_BPE:
        own = bpe.MergeQueueBpe(path, cache_words=50)  # small, so that generations change
        assert [own.encode(x) for x in texts] == want
        assert [own.decode(i) for i in want] == [t.decode(i, skip_special_tokens=False) for i in want]


def test_dac_random_access():
    rng = np.random.default_rng(1)
    ids = np.concatenate([rng.integers(0, 256, 700), rng.integers(0, 1 << 16, 700), rng.integers(0, 1 << 32, 700), [0, 255, 256, (1 << 32) - 1]]).astype(np.uint32)
    f = dac.DacFile(dac.encode_file([5, None, 7], [1000, 0, len(ids) - 1000], ids))
    assert (f.all() == ids).all()
    assert [f.access(i) for i in range(len(ids))] == ids.tolist()
    assert f.null.tolist() == [0, 1, 0] and f.ends.tolist() == [1000, 1000, len(ids)]
    with pytest.raises(IndexError):
        f.access(len(ids))
    assert len(dac.DacFile(dac.encode_file([], [], ids[:0])).all()) == 0


def test_dac_rotates_files(spark):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 20).alias("text"))
    got = sorted(map(tuple, dac.token_files(docs, BYTE_BPE, tokens_per_file=100).collect()))
    assert got == sorted(map(tuple, dac.token_files(docs, BYTE_BPE).collect()))
    assert [g[1] for g in got] == list(np.cumsum([0, *[g[2] for g in got[:-1]]]))


def best_fit(lengths, capacity):
    """Sequences that best-fit alone needs, longest first."""
    gaps = []
    for x in sorted(lengths, reverse=True):
        at = bisect.bisect_left(gaps, x)
        gap = gaps.pop(at) if at < len(gaps) else capacity
        bisect.insort(gaps, gap - x)
    return len(gaps)


def test_packing_plan_is_exact_where_it_can_be():
    assert packing.plan({100: 1}, 100) == [((100,), 1)]
    assert sum(n for _, n in packing.plan({60: 5, 25: 5, 15: 5}, 100)) == 5
    assert sum(n for _, n in packing.plan({40: 3, 30: 3, 20: 3, 10: 3}, 100)) == 3
    rng = random.Random(2)
    for _ in range(30):
        counts = {x: rng.randint(1, 50) for x in rng.sample(range(1, 65), 20)}
        made = packing.plan(counts, 64)
        back = dict.fromkeys(counts, 0)
        for lengths, n in made:
            assert sum(lengths) <= 64
            for x in lengths:
                back[x] += n
        assert back == counts
        assert sum(n for _, n in made) <= best_fit([x for x, n in counts.items() for _ in range(n)], 64)


def test_long_texts_are_read_whole_by_language_id(spark):
    model = language.learn(spark.createDataFrame([(1, "en", "the cat and the dog"), (2, "de", "der Hund und die Katze")], "doc_id long, lang string, text string"), F.lit(True))
    lang, score = model.predict(["the and the " * 3, None, "1234 ...", "the cat " + "und der die das " * 200_000, "x" * (1 << 18) + "the"])
    assert lang[:4] == ["en", "und", "und", "de"] and score[1] == score[2] == 0


def test_language_parts_sum_to_the_whole():
    text = "".join(random.Random(3).choice("abc äß") for _ in range(3 * (1 << 18) + 5))
    whole = np.zeros(language.BUCKETS, dtype=np.int64)
    n = 0
    for parts in language._parts([text, "ab"]):
        buckets, used = language._grams(parts)
        assert len(buckets) == used.sum()
        whole += np.bincount(buckets, minlength=language.BUCKETS)
        n += used.sum()
    assert n == len(text) + 2 == whole.sum()


def test_gam_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((3000, len(quality.FEATURES)))
    y = (x[:, 2] > 0.5) ^ (x[:, 5] > 0.5)
    model = quality.Gam(x[:2000], y[:2000], rounds=20)
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9
    assert (2, 5) in [p[:2] for p in model.pairs]


def brute(fps):
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a in fps:
        for b in fps:
            if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {f: find(f) for f in fps}


@pytest.mark.parametrize("crowded", [2, 64])
def test_simhash_links_with_crowded_buckets(spark, crowded):
    rng = random.Random(4)
    fps = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        fps |= {centre ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 3))}) for _ in range(25)}
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    distinct = spark.createDataFrame([(f,) for f in fps], "fp long")
    edges = simhash.links(distinct, crowded)
    want = {(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    assert {tuple(r) for r in edges.collect()} == want
    roots = {r["fp"]: r["root"] for r in simhash.components(edges).collect()}
    assert roots == {f: r for f, r in brute(fps).items() if any(f in e for e in want)}


def test_components_of_a_chain(spark):
    edges = spark.range(200).selectExpr("id * 7 % 211 AS a", "(id + 1) * 7 % 211 AS b").selectExpr("least(a, b) AS fa", "greatest(a, b) AS fb")
    assert {r["root"] for r in simhash.components(edges).collect()} == {0}


def archive():
    payloads = [b"", b"<p>one</p>", b"two\r\n\r\nWARC/1.1\r\nnot a record", b"three" * 500]
    return payloads, [warc.record(i, f"http://x/{i}", p, warc.digest_of(p), None) for i, p in enumerate(payloads)]


@pytest.mark.parametrize("zipped", [True, False])
def test_salvage(zipped):
    payloads, records = archive()
    parts = [warc.member(r) if zipped else r for r in records]
    whole = b"".join(parts)
    assert [(k, b) for k, _, b, _, _ in warc.salvage(whole)] == [("record", p) for p in payloads]
    for broken in range(4):
        at = sum(map(len, parts[:broken])) + (30 if zipped else len(records[broken]) - 5 - len(payloads[broken]) // 2)
        data = bytearray(whole)
        data[at] ^= 0xFF
        found = list(warc.salvage(bytes(data)))
        assert [f[2] for f in found if f[0] == "record"] == payloads[:broken] + payloads[broken + 1 :], broken
        gaps = [(f[3], f[4]) for f in found if f[0] == "gap"]
        assert gaps == [(sum(map(len, parts[:broken])), sum(map(len, parts[: broken + 1])))]
    cut = list(warc.salvage(b"rubbish" + whole[:-9]))
    assert [f[2] for f in cut if f[0] == "record"] == payloads[:-1] and [f[0] for f in cut].count("gap") == 2


def grouped(of):
    """Payloads, and members that hold so many of their records each."""
    payloads = [b"%d " % i * 400 + bytes(random.Random(i).randrange(256) for _ in range(3000)) for i in range(sum(of))]
    records = [warc.record(i, f"http://x/{i}", p, warc.digest_of(p), None) for i, p in enumerate(payloads)]
    members, at = [], 0
    for n in of:
        members.append(b"".join(records[at : at + n]))
        at += n
    return payloads, members


@pytest.mark.parametrize("of", [(5,), (2, 1), (1, 4, 3), (30,)])
def test_salvage_members_of_several_records(of):
    payloads, members = grouped(of)
    whole = b"".join(map(warc.member, members))
    assert [(k, b) for k, _, b, _, _ in warc.salvage(whole)] == [("record", p) for p in payloads]


def test_salvage_within_damaged_members():
    payloads, members = grouped((30, 2))
    parts = list(map(warc.member, members))
    data = bytearray(b"".join(parts))
    at = 9 * len(parts[0]) // 10
    data[at : at + 4] = bytes(255 - x for x in data[at : at + 4])
    found = list(warc.salvage(bytes(data)))
    got = [f[2] for f in found if f[0] == "record"]
    assert got[-2:] == payloads[-2:] and got[:10] == payloads[:10] and set(got) < set(payloads)
    gaps = [(f[3], f[4]) for f in found if f[0] == "gap"]
    assert len(gaps) == 1 and gaps[0][1] == len(parts[0]) and gaps[0][0] <= at + 4
    # rubbish between records of one sound member: the reader goes on at the next version line
    odd = warc.member(members[0][:-7] + b"rubbish" + members[1] + b"more")
    found = list(warc.salvage(odd + parts[1]))
    assert [f[2] for f in found if f[0] == "record"] == [*payloads[:29], *payloads[30:], *payloads[30:]]
    assert [f[0] for f in found].count("gap") == 1
    empty = list(warc.salvage(parts[1] + warc.member(b"nothing") + parts[1]))
    assert [f[0] for f in empty] == ["record"] * 2 + ["gap"] + ["record"] * 2


def test_inflation_has_a_ceiling():
    small, bomb, after = (warc.record(i, "u", p, warc.digest_of(p), None) for i, p in enumerate([b"one", b"0" * 50_000_000, b"two"]))
    for packed in ([small, bomb, after], [small + bomb + after]):
        found = list(warc.salvage(b"".join(map(warc.member, packed)), most=100_000))
        assert [f[2] for f in found if f[0] == "record"] == [b"one", b"two"] and [f[0] for f in found].count("gap") == 1
    assert [f[0] for f in warc.salvage(warc.member(small + bomb + after))] == ["record"] * 3


def test_stores_are_checked_at_the_start(tmp_path):
    files.check(f"file://{tmp_path}/new")
    with pytest.raises(ValueError, match="store"):
        files.check("viewfs://store/x")


def test_components_of_a_falling_chain(spark):
    n = 2000
    edges = spark.createDataFrame(list(zip([0, *range(n - 1, 1, -1)], range(n - 1, 0, -1), strict=True)), "fa long, fb long")
    assert {r["root"] for r in simhash.components(edges).collect()} == {0}


def test_warc_revisits_nulls_and_repeats(spark):
    pages = spark.createDataFrame([(1, "u", "same"), (2, None, "same"), (9, "w", "same"), (9, "w", "same"), (None, "n", "same"), (3, "e", None), (4, "e", ""), (5, "x y", "alone")], "page_id long, url string, html string")
    got = sorted(map(tuple, warc.archived(pages.withColumns({"digest": F.lit(1), "last": F.lit(2), "payload": F.lit(3)})).select("page_id", "payload_bytes", "record_type", "refers_to").collect()), key=str)
    assert got == sorted([(1, 4, "revisit", 9), (2, 4, "revisit", 9), (9, 4, "response", None), (9, 4, "response", None), (None, 4, "revisit", 9), (3, 0, "revisit", 4), (4, 0, "response", None), (5, 5, "response", None)], key=str)
    assert warc.archived(pages.limit(0)).collect() == []


def test_pipeline_stages(spark, sf_dir, tmp_path):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if k < len(p.STAGES) - 1:
            assert out.columns == columns
            assert 0 < out.count() <= before
            assert out.count() == out.select("doc_id").distinct().count()
            kept = {r["doc_id"]: r["text"] for r in out.collect()}
            assert all(docs.filter(F.col("doc_id") == d).first()["text"] == kept[d] for d in list(kept)[:3])
            if name == "exact_dedup":
                texts = [" ".join(t.split()) for t in kept.values()]
                assert len(texts) == len(set(texts))
            before, docs = out.count(), out
    assert {r["doc_id"] for r in out.select("doc_id").collect()} == set(kept)
