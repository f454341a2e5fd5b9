"""Each query against a brute-force version of its contract, over a whole small table."""

import base64
import hashlib
import json
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from emberline.llm import queries as q

WS = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(sf_dir):
    return {r[0]: r[1:] for r in duckdb.sql(f"SELECT doc_id, text, lang FROM '{sf_dir}/documents.parquet'").fetchall()}


def rows(df):
    return [r.asDict() for r in df.collect()]


def oracle(sf_dir, sql, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return sorted((dict(sorted(zip(names, r, strict=True))) for r in cur.fetchall()), key=lambda r: json.dumps(r))


def test_op1(spark, sf_dir, docs):
    got = sorted((dict(sorted(r.items())) for r in rows(q.op1_exact_dedup(spark, sf_dir))), key=lambda r: json.dumps(r))
    assert got == oracle(sf_dir, q.OP1_SQL, ["documents"])


def test_op2(spark, sf_dir, docs):
    got = rows(q.op2_sharding(spark, sf_dir))
    assert len(got) == len(docs)
    shards = defaultdict(list)
    for r in got:
        text = (docs[r["doc_id"]][0] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text) + 1, zlib.crc32(text), "rows", None)
        shards[r["shard"]].append(r["slot"])
    assert set(shards) == set(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    assert sorted(r["row_number"] for r in got) == list(range(len(docs)))
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["row_number"])] == sorted(docs)


def test_op3(spark, sf_dir, docs):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r["doc_id"]: r for r in rows(q.op3_bpe(spark, sf_dir))}
    assert set(got) == set(docs)
    for d, (text, _) in docs.items():
        ids = t.encode(text or "", add_special_tokens=False).ids
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), t.decode(ids, skip_special_tokens=False))]
        assert [got[d]["n_tokens"], got[d]["ids_sha256"], got[d]["decoded_sha256"]] == [len(ids), *sha]


def base_counts(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(8)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)]


def test_op4(spark, sf_dir, docs):
    got = {r["doc_id"]: r for r in rows(q.op4_quality_rules(spark, sf_dir))}
    assert set(got) == set(docs)
    for d, (text, _) in docs.items():
        n = base_counts(text)
        assert [got[d][k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == n
        assert got[d]["base_failed"] == (n[0] < 20 or 100 * n[4] > 30 * n[0])
        assert not (got[d]["base_failed"] and got[d]["kept"])
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{sf_dir}/labels.parquet'").fetchall())
    good = [got[d]["kept"] for d, v in labels.items() if v == 1]
    assert sum(good) > 0.85 * len(good)
    bad = [got[d]["kept"] for d, v in labels.items() if v == 0]
    assert sum(bad) <= 0.2 * len(bad)


def test_op5(spark, sf_dir, docs):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = rows(q.op5_packing(spark, sf_dir))
    by_doc, by_sequence, total = defaultdict(list), defaultdict(list), 0
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == set(docs)
    for d, (text, _) in docs.items():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        pieces = sorted(by_doc[d], key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(-(-len(ids) // 2048)))
        for r in pieces:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["start"] == 2048 * r["piece"] and r["length"] == min(2048, len(ids) - r["start"])
            assert r["ids_crc32"] == zlib.crc32(np.array(part, dtype="<u4").tobytes())
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by_sequence) <= 1.02 * -(-total // 2048) + 1


def held(d, m, r):
    return zlib.crc32(str(d).encode()) % m == r


def test_op6(spark, sf_dir, docs):
    got = {r["doc_id"]: r for r in rows(q.op6_language_id(spark, sf_dir))}
    assert set(got) == set(docs)
    out = [d for d in docs if held(d, 3, 1)]
    assert all(got[d]["held_out"] == held(d, 3, 1) and 0 <= got[d]["score"] <= 1 for d in docs)
    assert sum(got[d]["lang_pred"] == docs[d][1] for d in out) > 0.95 * len(out)


def test_op7(spark, sf_dir, docs):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = sorted(rows(q.op7_token_files(spark, sf_dir)), key=lambda r: r["doc_id"])
    assert [r["doc_id"] for r in got] == sorted(docs)
    start = 0
    for r in got:
        ids = [*t.encode(docs[r["doc_id"]][0] or "", add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)


def test_op8(spark, sf_dir):
    got = {r["page_id"]: r for r in rows(q.op8_warc(spark, sf_dir))}
    pages = {r[0]: (r[1] or "").encode() for r in duckdb.sql(f"SELECT page_id, html FROM '{sf_dir}/pages.parquet'").fetchall()}
    last = {}
    for p in sorted(pages):
        last[pages[p]] = p
    for p, html in pages.items():
        digest = base64.b32encode(hashlib.sha1(html).digest()).decode()
        assert got.pop(p) == {"page_id": p, "payload_bytes": len(html), "payload_digest": digest, "record_type": "response" if last[html] == p else "revisit", "refers_to": None if last[html] == p else last[html]}
    assert not got
    sql = oracle(sf_dir, q.OP8_SQL, ["pages"])
    mine = sorted((dict(sorted(r.asDict().items())) for r in q.op8_warc(spark, sf_dir).collect()), key=lambda r: json.dumps(r))
    assert mine == sql


def test_op9(spark, sf_dir, docs):
    got = {r["doc_id"]: r for r in rows(q.op9_quality_classifier(spark, sf_dir))}
    assert set(got) == set(docs)
    assert all(r["held_out"] == held(d, 4, 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for d, r in got.items())
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{sf_dir}/labels.parquet'").fetchall())
    good = [got[d]["score"] for d, v in labels.items() if v == 1 and held(d, 4, 2)]
    bad = [got[d]["score"] for d, v in labels.items() if v == 0 and held(d, 4, 2)]
    if good and bad:
        assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) > 0.9


def fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((sum(x >> b & 1 for x in h) * 2 > len(h)) << b for b in range(64)) if h else 0


def test_op10(spark, sf_dir, docs):
    got = {r["doc_id"]: r for r in rows(q.op10_simhash(spark, sf_dir))}
    fp = {d: fingerprint(t) for d, (t, _) in docs.items()}
    ids = sorted(docs)
    root = {d: d for d in ids}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fp[a] ^ fp[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {d: (r["fingerprint"], r["component_id"]) for d, r in got.items()} == {d: (f"{fp[d]:016x}", find(d)) for d in ids}
