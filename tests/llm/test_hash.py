"""Strings on which a polynomial modulo 2**64 falls on equal values, whatever its base: Thue-Morse words."""

import hashlib
import zlib

import numpy as np
import pytest

from sentinela.llm import fingerprints, near, packing, ppm, quality, queries, repeats
from sentinela.llm import kernels as K

TM = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
OTHER = TM.translate(str.maketrans("ab", "ba"))


@pytest.fixture(scope="module")
def pair(spark):
    return spark.createDataFrame([(1, TM), (2, OTHER), (3, TM)], "doc_id long, text string")


def test_spans():
    data, offs = K.flat(__import__("pyarrow").array([TM, OTHER, "x" + TM, TM[:40], OTHER[:40]]))
    begin = offs[:-1] + np.array([0, 0, 1, 0, 0])
    h = K.span_hash(K.prefix_hash(data), begin, offs[1:])
    assert h[0] == h[2] and len(set(h.tolist())) == 4


def test_near_links_equal_ones_only(pair):
    got = {(r.doc_id, r.component_id) for r in near.near_duplicates(pair).collect()}
    assert got == {(1, 1), (2, 2), (3, 1)}


def test_fingerprints_differ(pair):
    got = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint_documents(pair).collect()}
    assert got[1] == got[3] != got[2]


def test_lines_differ():
    data = np.frombuffer(f"{TM}\n{OTHER}\n{TM}".encode(), np.uint8)
    assert quality.measure(data, np.array([0, len(data)]))["n_dup_lines"].tolist() == [1]


def test_ids_are_the_tokenizers(pair):
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.vocabulary_path()
    whole = tokenizers.Tokenizer.from_file(path)
    want = {i: zlib.crc32(np.array([*whole.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in ((1, TM), (2, OTHER), (3, TM))}
    got = {r.doc_id: r.ids_crc32 for r in packing.pack_documents(pair, path).collect()}
    assert got == want


def test_repeated_bytes_are_equal(pair):
    got = {r.doc_id: (r.n_removed, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in repeats.cut_repeats(pair).collect()}
    seen = {}
    texts = {1: TM.encode(), 2: OTHER.encode(), 3: TM.encode()}
    for t in texts.values():
        for i in range(len(t) - 199):
            seen[t[i : i + 200]] = seen.get(t[i : i + 200], 0) + 1
    for k, t in texts.items():
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        assert got[k] == (sum(gone), hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest())


def test_a_word_is_known_by_its_letters(spark):
    ids = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 5 == 1][:1] + [i for i in range(1000) if zlib.crc32(str(i).encode()) % 5 != 1][:1]
    docs = spark.createDataFrame([(ids[0], f"{OTHER} plain"), (ids[1], f"{TM} plain")], "doc_id long, text string")
    got = {r.doc_id: r.n_known for r in ppm.score(docs).collect()}
    assert got[ids[0]] == 2 and got[ids[1]] == 3  # "plain" and the end; the training text's own word too
