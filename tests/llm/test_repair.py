import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from karst.llm import repair
from karst.llm.common import Scratch

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["The cat, the cat.", None, "", "I'M don'T 'RE", "<|endoftext|> A <|ENDOFTEXT|>", "Á J̌ É Straße ÉÉ", "x y\x1cz  \n\n", "漢字 😀", "a" * 5000, "the of and " * 3000, "!!,, THE!! ..."]


def test_ids_are_the_library_s():
    e = repair.WordEncoder(PATH)
    ids, cuts = e.encode(TEXTS, 2)
    for t, a, b in zip(TEXTS, cuts, cuts[1:]):
        assert ids[a:b].tolist() == [*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 2]


def test_ids_of_odd_words_are_the_library_s():
    """Words are cut where letters and punctuation meet; contractions, marks that join, special tokens and letters that grow when lowered must not suffer."""
    e, r = repair.WordEncoder(PATH), random.Random(5)
    parts = [*"abzABZ019 .,'-_<|>=\n\té×÷ßÑñ…“”\u0338\u0301漢😀İſK\u00a0\u200b", "'s", "'ll", "<|endoftext|>", "it's", "a=", "ó,", "%%%", "***"]
    for _ in range(1500):
        texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(4)]
        ids, cuts = e.encode(texts, None)
        for t, a, b in zip(texts, cuts, cuts[1:]):
            assert ids[a:b].tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, t


def slow_grammar(docs, base):
    """Every pair counted afresh in each round, nothing carried over."""
    rules = []
    while True:
        count = collections.Counter(p for d in docs for p in zip(d, d[1:]))
        top = sorted((p for p, c in count.items() if c >= repair.LEAST), key=lambda p: (-count[p], p))[: repair.PER_ROUND]
        if not top:
            return docs, rules
        new = {p: base + len(rules) + i for i, p in enumerate(top)}
        rules += top
        out = []
        for d in docs:
            made, i = [], 0
            while i < len(d):
                if i + 1 < len(d) and (d[i], d[i + 1]) in new:
                    made.append(new[d[i], d[i + 1]])
                    i += 2
                else:
                    made.append(d[i])
                    i += 1
            out.append(made)
        docs = out


@pytest.mark.parametrize("seed", range(6))
def test_grammar_as_by_brute_force(seed):
    r = random.Random(seed)
    letters = [range(3), range(40), [7, 7, 7, 8], range(400), [60000, 1, 2], range(12)][seed]
    phrase = [r.choice(letters) for _ in range(30)]
    docs = [[x for _ in range(r.randint(0, 12)) for x in r.choice([phrase, phrase[3:9], [r.choice(letters)], [r.choice(letters) for _ in range(5)]])] for _ in range(60)]
    ids, cuts = np.array([x for d in docs for x in d], np.uint32), np.cumsum([0, *map(len, docs)])
    seq, at, left, right = repair.compress(ids, cuts)
    want, rules = slow_grammar(docs, int(ids.max()) + 1)
    assert rules and list(zip(left.tolist(), right.tolist())) == rules
    assert [x.tolist() for x in np.split(seq, at[1:-1])] == want


def test_the_least_doc_id_is_no_null(spark):
    docs = spark.createDataFrame([(None, "a"), (-(2**63), "b"), (None, None)], "doc_id long, text string")
    got = repair.read_shards(repair.write_shards(docs, PATH, 2, Scratch(spark, "t"))).collect()
    assert sorted((r.doc_id is None, r.start) for r in got) == [(False, 3), (True, 0), (True, 1)] and {r.doc_id for r in got} == {None, -(2**63)}


@pytest.mark.parametrize("seed", range(4))
def test_grammar_round_trip(seed):
    r = random.Random(seed)
    docs = [[r.choice([7, 8, 9, 10, 49000] if seed else range(49000)) for _ in range(r.choice([0, 1, 2, 500, 3000]))] + [2] for _ in range(40)]
    ids, cuts = np.array([x for d in docs for x in d], np.uint32), np.cumsum([0, *map(len, docs)])
    blob = repair.pack(np.arange(40), ids, cuts)
    s = repair.Shard(blob)
    assert s.ids().tolist() == ids.tolist() and s.cuts.tolist() == cuts.tolist()
    for i in (0, 7, 39):
        assert s.document(i).tolist() == docs[i]
        a, b = sorted((r.randrange(len(docs[i]) + 1), r.randrange(len(docs[i]) + 1)))
        assert s.document(i, a, b).tolist() == docs[i][a:b]
    assert not seed or len(s.size) and len(blob) < 2 * len(ids) + 2000


def test_wide_symbols_and_rules_of_rules():
    ids = np.array([70000, 70001] * 2000 + [2], np.uint32)
    s = repair.Shard(repair.pack(np.array([1]), ids, np.array([0, len(ids)])))
    assert s.ids().tolist() == ids.tolist() and s.size.max() >= 8


def test_no_pair_stays_frequent():
    r = np.random.default_rng(3)
    one = r.integers(0, 49000, 500)
    zipf = np.minimum(r.zipf(1.2, 300_000), 49000)
    for docs in ([one] * 400, [r.permutation(one[:60]) for _ in range(300)], np.split(zipf, 300), [np.append(x, 70000) for x in np.split(zipf, 300)]):
        ids, cuts = np.concatenate(docs).astype(np.uint32), np.cumsum([0, *map(len, docs)])
        seq, at, left, right = repair.compress(ids, cuts)
        pairs = np.concatenate([np.stack([d[:-1], d[1:]], 1) for d in np.split(seq, at[1:-1])])
        assert np.unique(pairs, axis=0, return_counts=True)[1].max(initial=0) < repair.LEAST
        assert repair.Shard(repair.pack(np.arange(len(docs)), ids, cuts)).ids().tolist() == ids.tolist()
    assert len(repair.compress(np.tile(one, 400).astype(np.uint32), np.arange(401) * 500)[0]) == 400


def test_files(spark, odd, none):
    docs = odd.union(odd.limit(2)).repartition(3)
    out = repair.read_shards(repair.write_shards(docs, PATH, 2, Scratch(spark, "t"))).collect()
    e, at = repair.WordEncoder(PATH), 0
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    got = sorted(out, key=lambda r: r.start)
    assert [r.doc_id for r in got] == [r[0] for r in rows]
    for r, (_, t) in zip(got, rows):
        ids = np.array([*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert repair.read_shards(repair.write_shards(none, PATH, 2, Scratch(spark, "t"))).collect() == []
