"""Packing under three limits: every token once, limits kept, hardly any padding."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from emberline.llm import queries as q
from emberline.llm import vector_packing as vp

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def checked(losses, limits, cut=True):
    """The lengths of the sequences, after a look at every rule."""
    pieces = vp.place(losses, limits, cut)
    tokens, segments, loss, parts = Counter(), Counter(), Counter(), defaultdict(list)
    at = defaultdict(list)
    for p in pieces:
        assert p.length > 0 and p.loss == losses[p.example][p.start : p.start + p.length].sum()
        tokens[p.sequence] += p.length
        segments[p.sequence] += 1
        loss[p.sequence] += p.loss
        parts[p.example].append((p.start, p.length))
        at[p.sequence].append((p.offset, p.length))
    for i, x in enumerate(losses):
        end = 0
        for start, length in sorted(parts[i]):
            assert start == end
            end += length
        assert end == len(x)
        if not cut and len(x) <= limits.tokens and x.sum() <= limits.loss:
            assert len(parts[i]) == 1
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
    assert sorted(tokens) == list(range(len(tokens)))
    assert max(tokens.values()) <= limits.tokens and max(segments.values()) <= limits.segments and max(loss.values()) <= limits.loss
    return list(tokens.values())


@pytest.mark.parametrize("limits", [vp.Limits(), vp.Limits(loss=300), vp.Limits(segments=3), vp.Limits(1000, 5, 200), vp.Limits(1, 1, 1), vp.Limits(8, 2, 3)])
@pytest.mark.parametrize("seed", range(3))
def test_rules_hold(limits, seed):
    rng = np.random.default_rng(seed)
    losses = [(rng.random(n) < rng.random()) & (np.arange(n) > 0) for n in rng.integers(1, 40 if limits.tokens < 100 else 3000, 60)]
    used = checked(losses, limits)
    assert vp.padding(used, limits.tokens) == 0 or limits.tokens & (limits.tokens - 1)
    checked(losses, limits, cut=False)


def test_few_sequences_and_no_padding_where_tokens_decide():
    rng = np.random.default_rng(7)
    losses = [np.arange(n) > 0 for n in rng.integers(1, 3000, 1500)]
    used = checked(losses, vp.Limits())
    assert vp.padding(used, 1024) == 0 and len(used) <= 1.01 * sum(used) / 1024


def test_the_scarce_limit_decides():
    """Long examples without loss and short ones with much go together, so both limits are filled."""
    losses = [np.zeros(800, dtype=bool)] * 40 + [np.arange(200) > 0] * 40
    assert len(checked(losses, vp.Limits(tokens=1000, segments=8, loss=199), cut=False)) == 40
    with pytest.raises(ValueError):
        vp.place(losses, vp.Limits(tokens=0))


def test_padding_spares_powers_of_two():
    assert vp.padding([1024, 512, 1, 1023, 700], 1024) == 1 + 324


def test_op12(spark, sf_dir):
    t = Tokenizer.from_file(BYTE_BPE)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = q.op12_vector_packing(spark, sf_dir).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == set(docs)
    for d, text in docs.items():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        end = 0
        for r in sorted(by_doc[d], key=lambda r: r["start"]):
            assert r["start"] == end and r["length"] > 0 and r["doc_tokens"] == len(ids)
            end += r["length"]
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : end], dtype="<u4").tobytes())
        assert end == len(ids)
    lengths = []
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024 and len(parts) <= 64
        lengths.append(end)
    assert vp.padding(lengths, 1024) == 0


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "a b", 5), (3, "same text", 5), (3, "same text", 5), (4, "<|endoftext|> x", 5), (5, "word " * 30_000, 5)], "doc_id long, text string, length int")
    got = vp.pack(docs.repartition(3), BYTE_BPE).collect()
    total = Counter()
    for r in got:
        total[r["doc_id"]] += r["length"]
    assert total[1] == total[2] == 1 and total[3] == 2 * 3 and total[None] == 3
    assert total[4] == len(Tokenizer.from_file(BYTE_BPE).encode("<|endoftext|> x", add_special_tokens=False).ids) + 1
    used = Counter()
    for r in got:
        used[r["sequence_id"]] += r["length"]
    assert vp.padding(list(used.values()), 1024) == 0
    assert vp.pack(docs.limit(0), BYTE_BPE).collect() == []


def test_blocks_cost_no_padding(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    used = vp.pack(docs, BYTE_BPE, block=5000).groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert vp.padding([r[1] for r in used], 1024) == 0


def test_instructions(spark, sf_dir):
    """Conversations whole, answers bear loss, all three limits at once."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    t = Tokenizer.from_file(BYTE_BPE)
    limits = vp.Limits(1024, 4, 700)
    got = vp.pack_examples(vp.instructions(turns), BYTE_BPE, limits, cut=False).collect()
    want = {}
    for conv, rows in {c: sorted([r for r in turns.collect() if r["conv_id"] == c], key=lambda r: (r["turn"] is not None, r["turn"], r["role"], r["text"] or "")) for c in {r["conv_id"] for r in turns.select("conv_id").collect()}}.items():
        ids = [t.encode(r["text"] or "", add_special_tokens=False).ids for r in rows]
        loss = [r["role"] == "assistant" for r, own in zip(rows, ids, strict=True) for _ in own] + [rows[-1]["role"] == "assistant"]
        want[conv] = (len(loss), sum(loss[1:]))
    tokens, loss, pieces = Counter(), Counter(), Counter()
    of = defaultdict(lambda: [0, 0, 0])
    for r in got:
        tokens[r["doc_id"]] += r["length"]
        loss[r["doc_id"]] += r["loss_tokens"]
        pieces[r["doc_id"]] += 1
        for k, x in enumerate((r["length"], 1, r["loss_tokens"])):
            of[r["sequence_id"]][k] += x
    assert {c: (tokens[c], loss[c]) for c in tokens} == want
    assert all(pieces[c] == 1 for c, (n, bears) in want.items() if n <= 1024 and bears <= 700)
    assert all(a <= 1024 and b <= 4 and c <= 700 for a, b, c in of.values())
    odd = spark.createDataFrame([(1, None), (2, []), (3, [None, ("x", None), (None, True)])], "doc_id long, parts array<struct<text: string, loss: boolean>>")
    assert {r["doc_id"]: (r["length"], r["loss_tokens"]) for r in vp.pack_examples(odd, BYTE_BPE).collect()} == {1: (1, 0), 2: (1, 0), 3: (2, 1)}
