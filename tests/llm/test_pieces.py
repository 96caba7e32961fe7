import re
import numpy as np
import public_tokenizers
import sentencepiece

from karst.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "Hello world", "  two  blanks ", "\n\n x\ny ", "漢字かな交じり文" * 30, "x" * 300 + "the" * 100, "\x00\x01 é\r\n\t z", "😀 naïve 1234.5", " " * 90 + "b", "internationalization of everything"]


def test_without_dropout_as_the_library():
    p, sp = pieces.Pieces(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    ids, cuts = p.encode(TEXTS, [0] * len(TEXTS), 1, 0.0)
    for t, a, b in zip(TEXTS, cuts, cuts[1:]):
        assert ids[a:b].tolist() == sp.encode(t or "")


def test_dropout_is_seeded_varied_and_lossless():
    p = pieces.Pieces(PATH)
    texts = [*TEXTS, "a▁b ▁▁", "unbelievable understanding " * 20]
    seen = set()
    for seed in (1, 2):
        for variant in (0, 1):
            ids, cuts = p.encode(texts, [variant] * len(texts), seed, 0.3)
            again, _ = pieces.Pieces(PATH).encode(list(reversed(texts)), [variant] * len(texts), seed, 0.3)
            assert sorted(ids.tolist()) == sorted(again.tolist())
            seen.add(tuple(ids.tolist()))
            for t, a, b in zip(texts, cuts, cuts[1:]):
                assert p.decode(ids[a:b].tolist()) == (t or "")
    assert len(seen) == 4


def test_heap_and_rounds_agree():
    p = pieces.Pieces(PATH)
    words = [" understanding", " internationalization", "abcabcabc", " the"]
    for dropout in (0.0, 0.3):
        p.clear()
        p._learn(words, 1, 5, dropout)
        fast = [p.ids[p.start[i] : p.start[i] + p.size[i]].tolist() for i in range(len(words))]
        old, pieces.LONG = pieces.LONG, 0
        try:
            p.clear()
            p._learn(words, 1, 5, dropout)
        finally:
            pieces.LONG = old
        assert fast == [p.ids[p.start[i] : p.start[i] + p.size[i]].tolist() for i in range(len(words))]


def test_every_occurrence_is_drawn_for_itself():
    p = pieces.Pieces(PATH)
    text = "internationalization " * 400
    seen = set()
    for doc in range(20):
        ids, _ = p.encode([text], [doc], 3, 0.3)
        assert p.decode(ids.tolist()) == text
        words, at = p._direct([" internationalization"] * 400, p._own(np.full(400, doc), np.arange(400), 3), 0.3)
        assert ids[: len(words)].tolist() == words.tolist()
        seen.add(tuple(ids.tolist()))
        n = len(set(map(tuple, np.split(words, np.flatnonzero(np.diff(at) > 0) + 1))))
        assert n > 50
    assert len(seen) == 20


def test_nodes_and_single_runs_agree():
    p = pieces.Pieces(PATH)
    for dropout in (0.0, 0.1, 0.5, 0.9):
        docs = list(range(len(TEXTS)))
        ids, cuts = p.encode(TEXTS, docs, 5, dropout)
        for d, t, a, b in zip(docs, TEXTS, cuts, cuts[1:]):
            words = re.findall(r"\n| *[^ \n]+| +", " " + t) if t else []
            want, _ = p._direct(words, p._own(np.full(len(words), d), np.arange(len(words)), 5), dropout)
            assert ids[a:b].tolist() == want.tolist()


def test_full_dropout_leaves_characters():
    p = pieces.Pieces(PATH)
    ids, _ = p.encode(["the cat"], [0], 1, 1.0)
    assert len(ids) == len(" the cat")


def test_tables(spark, odd, none):
    enc = pieces.encode(odd, PATH)
    assert enc.columns == ["doc_id", "ids", "n_ids"]
    back = sorted((r.doc_id or 0, r.text) for r in pieces.decode(enc, PATH).collect())
    assert back == sorted((r.doc_id or 0, r.text or "") for r in odd.collect())
    d = pieces.digests(odd, PATH).collect()
    assert len(d) == odd.count() and all(r.lossless for r in d)
    assert pieces.encode(none, PATH).collect() == pieces.digests(none, PATH).collect() == []
