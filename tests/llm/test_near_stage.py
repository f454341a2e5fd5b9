"""The near-duplicate stage against brute-force Jaccard similarity, with planted copies between 0.8 and 0.97."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingled(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def planted():
    """Texts by doc_id: originals, copies with a run of words replaced or a header added, a chain, short ones, a passage that many share."""
    r = random.Random(7)
    word = lambda: "".join(r.choices("abcdefghij", k=6))
    texts, passage = [], [word() for _ in range(30)]
    for k in range(40):
        words = [word() for _ in range(120 + 5 * k)]
        texts.append(words)
        for share in (0.01, 0.04, 0.06, 0.08, 0.1, 0.14):
            n = max(1, int(share * len(words)))
            at = r.randrange(len(words) - n)
            texts.append(words[:at] + [word() for _ in range(n)] + words[at + n :])
        texts.append([word() for _ in range(8)] + words)
    chain = [word() for _ in range(150)]
    for k in range(12):
        chain = [*chain[:10 * k], *[word() for _ in range(10)], *chain[10 * k + 10 :]]
        texts.append(chain)
    texts += [passage + [word() for _ in range(k % 14)] for k in range(60)]
    texts += [[word() for _ in range(n)] for n in range(1, 8)]
    r.shuffle(texts)
    return {d: " ".join(w) for d, w in enumerate(texts)}


def test_near_stage_equals_brute_force(spark):
    import corpus_pipeline as p

    texts = planted()
    sets = {d: shingled(t) for d, t in texts.items()}
    root, between = {d: d for d in texts}, 0

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in texts:
        for b in range(a + 1, len(texts)):
            if (j := jaccard(sets[a], sets[b])) >= 0.8:
                between += j < 0.97
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert between > 200
    docs = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in texts.items()], SCHEMA)
    got = p.near_stage(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted({find(d) for d in texts})


def test_rows_without_ids_and_shared_ids_stay(spark, sf_dir, tmp_path):
    import corpus_pipeline as p

    r = random.Random(5)
    base = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = [" ".join("".join(r.choices("abcdefghij", k=6)) for _ in range(60)) for _ in range(6)]
    rows = [(None, t, "en", "a", 9) for t in texts[:4]] + [(900_000_001, t, "en", "a", 9) for t in texts[4:]] + [(None, texts[0], "en", "a", 9), (900_000_001, texts[5], "en", "a", 9)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for stage in (p.exact_stage, p.near_stage):
        assert sorted(x["text"] for x in stage(spark, docs, sf_dir).collect()) == sorted(texts)
    good = [x["text"] for x in p.quality_stage(spark, p.language_stage(spark, base, sf_dir), sf_dir).limit(3).collect()]
    mixed = base.unionByName(spark.createDataFrame([(None, t, "en", "a", 9) for t in [*good, "", "12 34", None]], SCHEMA), allowMissingColumns=True)
    mixed.write.parquet(str(tmp_path / "docs"))
    for docs in (mixed, spark.read.parquet(str(tmp_path / "docs"))):
        got = p.language_stage(spark, docs, sf_dir).filter("doc_id IS NULL")
        assert sorted(x["text"] for x in got.collect()) == sorted(good)
    junk = "$$$$ #### 1234 |||| " * 40
    docs = base.unionByName(spark.createDataFrame([(None, good[0], "en", "a", 9), (None, junk, "en", "a", 9)], SCHEMA), allowMissingColumns=True)
    assert [x["text"] for x in p.quality_stage(spark, docs, sf_dir).filter("doc_id IS NULL").collect()] == [good[0]]
