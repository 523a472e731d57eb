"""Tokenized outputs: ids, packing and ORC files against the plain tokenizer."""

import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.orc as orc
import pytest

from netpulse.llm import packing, token_files
from netpulse.llm.queries import TOKENIZER
from netpulse.llm.tokens import Encoder


@pytest.fixture(scope="module")
def plain():
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    return lambda t: np.array(tok.encode(t or "", add_special_tokens=False).ids, "<u4")


def test_encoder_equals_tokenizer(plain):
    texts = ["", None, "a.́b word.\" x!!é", "It's don't he'll.", "<|endoftext|> Ab <|startoftext|>", "İstanbul ΣΑΣ naïve... café!",
             "a b\u0085c d e 12,345.67% x_y-z (a.b)", "\x1cfoo bar\x00baz", "Ａ１ ①② ½ ªº ﬁ", "é.é é. Å!! ÉÈ", "x" * 5000 + " .", "a,b;c!? #$ %%"]
    rng = random.Random(0)
    letters = "abcdeABC .,!?'\"-éÉßüñ \n\t0123456789<|>_"
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(200))) for _ in range(300)]
    enc = Encoder(TOKENIZER)
    got = [x for _, _, ids, ends in enc.encode(pa.array(texts)) for x in np.split(ids, ends[:-1])]
    assert len(got) == len(texts)
    for t, g in zip(texts, got):
        assert g.tolist() == plain(t).tolist(), t
    assert list(enc.encode(pa.array([], pa.string()))) == []


def packed(rows, result, plain, capacity, end_id):
    want = []
    for doc_id, text in rows:
        ids = np.append(plain(text), np.uint32(end_id)).astype("<u4")
        want += [(doc_id, k // capacity, k, len(ids[k : k + capacity]), zlib.crc32(ids[k : k + capacity].tobytes()))
                 for k in range(0, len(ids), capacity)]
    assert sorted(want, key=str) == sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in result], key=str)
    by = {}
    for r in result:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(make, prose, odd_rows, plain):
    rows = prose + odd_rows
    result = packing.best_fit_packing(make(rows), TOKENIZER, capacity=256).collect()
    n = packed(rows, result, plain, 256, 0)
    assert n <= 1.01 * packing.lower_bound(np.array([r.length for r in result]), 256)
    result = packing.best_fit_packing(make(rows), TOKENIZER, capacity=256, group_pieces=50).collect()
    packed(rows, result, plain, 256, 0)  # several groups
    assert packing.best_fit_packing(make([]), TOKENIZER).collect() == []


def exact_bins(lengths, capacity):
    """The fewest bins, by dynamic programming over subsets."""
    n = len(lengths)
    best = {0: (1, 0)}
    for mask in range(1, 1 << n):
        best[mask] = min(((b + (used + lengths[i] > capacity)), (lengths[i] if used + lengths[i] > capacity else used + lengths[i]))
                         for i in range(n) if mask >> i & 1 for b, used in [best[mask ^ (1 << i)]])
    return best[(1 << n) - 1][0]


def test_bin_completion_is_optimal_on_small_sets():
    rng = random.Random(7)
    for _ in range(60):
        lengths = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
        bins = packing.bin_completion(lengths, 20, nodes=2000)
        assert sorted(x for b in bins for x in b) == sorted(lengths)
        assert max(map(sum, bins)) <= 20
        assert len(bins) == exact_bins(lengths, 20) >= packing.lower_bound(np.array(lengths), 20)


def test_bin_completion_improves_best_fit():
    better = 0
    rng = random.Random(1)
    for _ in range(30):
        lengths = [rng.randint(150, 500) for _ in range(60)]
        found, greedy = packing.bin_completion(lengths, 1000, 500), packing.best_fit(lengths, 1000)
        assert len(found) <= len(greedy)
        better += len(found) < len(greedy)
    assert better


def test_fillings_are_all_enumerated_once():
    left = packing._Left([7, 7, 6, 5, 5, 4, 3, 2, 2, 1], 20)
    for room in (4, 11, 20):
        for common_first in (False, True):
            got = list(packing.fillings(left, room, common_first))
            every = {t for r in range(11) for t in itertools.combinations([7, 7, 6, 5, 5, 4, 3, 2, 2, 1], r) if sum(t) <= room}
            assert sorted(f for _, f, _ in got) == sorted(every)
            assert [w for w, _, _ in got] == sorted(room - sum(f) for f in every)


def test_bin_completion_reaches_middling_lengths():
    """Exact triples of lengths in which the longest pieces alone say little."""
    rng = random.Random(1)
    lengths = []
    while len(lengths) < 1500:
        a, b = rng.randint(520, 860), rng.randint(520, 860)
        if 520 <= 2048 - a - b <= 860:
            lengths += [a, b, 2048 - a - b]
    bins = packing.bin_completion(lengths, 2048, nodes=2 * len(lengths))
    assert sorted(x for b in bins for x in b) == sorted(lengths)
    assert max(map(sum, bins)) <= 2048
    assert len(packing.best_fit(lengths, 2048)) > 1.05 * 500
    assert len(bins) <= 1.02 * 500


def test_orc_round_trip(spark, make, prose, odd_rows, plain, tmpdir_path):
    rows = prose + odd_rows
    path = token_files.new_folder(spark, "t")
    token_files.write_token_ids(make(rows), path, TOKENIZER, end_id=1)
    got = token_files.stored_digest(spark, path).collect()
    ids = {(i, zlib.crc32(a.tobytes())): a for i, t in rows for a in [np.append(plain(t), np.uint32(1)).astype("<u4")]}
    assert sorted([(r.doc_id, r.n_tokens, r.ids_crc32) for r in got], key=str) == sorted(
        [(i, len(ids[k]), k[1]) for i, t in rows for k in [(i, zlib.crc32(np.append(plain(t), np.uint32(1)).astype("<u4").tobytes()))]], key=str)
    at = 0  # documents lie one after another, ascending by id
    order = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in order] == sorted([i for i, _ in rows], key=lambda i: (i is not None, i or 0))
    for r in order:
        assert r.start == at
        at += r.n_tokens
    stored = token_files.read_token_ids(spark, path)
    assert [np.array(r.ids, "<u4").tolist() for r in stored.where("doc_id = 33").collect()] == [
        np.append(plain(dict(rows)[33]), 1).tolist()]
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,33)]" in stored.where("doc_id = 33")._jdf.queryExecution().toString()
    files = [f for f in spark.read.format("binaryFile").load(path).select("path").collect()]
    f = orc.ORCFile(files[0].path.removeprefix("file:"))
    assert f.nstripes >= 1 and f.row_index_stride == 1000


def test_orc_of_an_empty_table(spark, make):
    path = token_files.new_folder(spark, "t")
    token_files.write_token_ids(make([]), path, TOKENIZER)
    assert token_files.stored_digest(spark, path).collect() == []
