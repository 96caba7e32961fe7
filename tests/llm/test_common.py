"""Work in pieces gives what work on the whole gives."""

import random

import numpy as np
import pytest

from karst.llm import common, quality


def rows(seed):
    r = random.Random(seed)
    texts = ["".join(r.choice("ab  \nXYZé") for _ in range(r.randint(0, 40))).encode() for _ in range(r.randint(0, 6))]
    return texts, np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


@pytest.mark.parametrize("piece", [4, 7, 64])
def test_words_and_features_in_pieces(monkeypatch, piece):
    for seed in range(80):
        texts, raw, off = rows(seed)
        h, first = common.word_hashes(raw, off)
        ids, row = quality.features(raw, off)
        assert np.diff(first).tolist() == [len(t.split()) for t in texts]
        with monkeypatch.context() as m:
            m.setattr(common, "PIECE", piece)
            m.setattr(common, "_POW", [np.ones(1, np.uint64)] * 2)
            m.setattr(quality, "PIECE", piece)
            h2, first2 = common.word_hashes(raw, off)
            ids2, row2 = quality.features(raw, off)
        assert (h == h2).all() and (first == first2).all()
        assert sorted(zip(ids.tolist(), row.tolist())) == sorted(zip(ids2.tolist(), row2.tolist()))


def test_equal_words_have_equal_hashes_anywhere():
    _, raw, off = [0], np.frombuffer(b"Word x " * 50 + b"word", np.uint8), np.array([0, 354])
    h, _ = common.word_hashes(raw, off)
    assert len(set(h.tolist())) == 2


def test_no_powers_are_kept_beyond_a_piece():
    raw = np.full(3 * common.PIECE, 97, np.uint8)
    common.word_hashes(raw, np.array([0, len(raw)]))
    assert len(common._POW[0]) <= common.PIECE + 1


def test_arrays_in_files(tmp_path, monkeypatch):
    common.save_array(f"file://{tmp_path}/m", "a", np.arange(5))
    assert common.load_array(f"file://{tmp_path}/m", "a").tolist() == [0, 1, 2, 3, 4]
    monkeypatch.setattr(common, "HELD_MAPS", 2)
    for name in "vwxyz":
        common.save_array(f"file://{tmp_path}/m", name, np.arange(3))
        assert common.load_array(f"file://{tmp_path}/m", name).tolist() == [0, 1, 2] and len(common._held) <= 2
    monkeypatch.setattr(common, "local_path", lambda uri: None)  # a store without a file system
    monkeypatch.setattr(common, "HELD_BYTES", 50)
    common._held.clear()
    for name in "bcd":
        common.save_array(f"file://{tmp_path}/m", name, np.arange(5))
    assert [common.load_array(f"file://{tmp_path}/m", n).tolist() for n in "bcdb"] == [[0, 1, 2, 3, 4]] * 4 and len(common._held) == 1
    common._held.clear()


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace as Of

    conf = Of(get=lambda *a: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Of(sparkContext=Of(getConf=lambda: conf, master="spark://a:1"), conf=conf))
