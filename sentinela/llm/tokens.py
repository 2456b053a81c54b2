"""Token ids of whole texts by the ``tokenizers`` library, with a vocabulary file that the caller names.

Only distinct pieces of text go through the library. The vocabulary's own splitter never lets a token cross
white space, and splits a chunk of plain letters, digits and ASCII punctuation into letter runs, single digits
and punctuation runs; these pieces are cut with numpy, each distinct one is encoded once, and the ids of a text
are gathered from that table. A chunk with anything else (apostrophes, marks, other numbers or blanks, special
tokens, text that Unicode normalisation or case folding would change in length) is encoded whole by the
unchanged tokenizer, so that the ids are exactly those of encoding the text in one call.
"""

from __future__ import annotations

import os
import sys
import types
import unicodedata

import numpy as np

from sentinela.llm import kernels as K

#: Entries in a worker's table of pieces before it starts anew; bounds memory, never changes a result.
TABLE_MOST = 700_000

_CLASS = np.full(256, 2, np.uint8)  # punctuation and control characters
_CLASS[list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = 1
_CLASS[48:58] = 3
_CLASS[K.SPACE] = 0


class PieceTable:
    """The ids of every piece met so far in this worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_file(path)
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(self.whole.get_vocab_size(), bool)
        for token, i in self.whole.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.clear()

    def clear(self) -> None:
        self.slots = K.Slots()
        self.odd_keys = np.zeros(0, np.uint64)
        self.first = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _add(self, keys: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        n = len(self.first) - 1
        self.ids = np.concatenate([self.ids, ids])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(lengths)])
        self.slots.add(keys, np.arange(n, n + len(keys)))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Entries, -1 where unknown."""
        return self.slots.find(keys)

    def learn_plain(self, keys: np.ndarray, texts: list[str]) -> None:
        runs = [" ".join(texts[i : i + 1000]) for i in range(0, len(texts), 1000)]
        ids = np.concatenate([np.asarray(e.ids, np.int32) for e in self.plain.encode_batch_fast(runs, add_special_tokens=False)])
        last = np.flatnonzero(self.ends[ids])
        if len(last) != len(keys):  # cannot be told apart in one go: one by one
            each = [np.asarray(self.plain.encode(t, add_special_tokens=False).ids, np.int32) for t in texts]
            self._add(keys, np.concatenate(each), np.array([len(x) for x in each]))
            return
        self._add(keys, ids, np.diff(np.concatenate([[-1], last])))

    def learn_whole(self, keys: np.ndarray, texts: list[str]) -> None:
        each = [np.asarray(e.ids, np.int32) for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
        self._add(keys, np.concatenate([*each, np.zeros(0, np.int32)]), np.array([len(x) for x in each], np.int64))


def piece_table(path: str) -> PieceTable:
    """This worker's table; it outlives a task because workers are reused."""
    home = sys.modules.setdefault("_sentinela_worker", types.ModuleType("_sentinela_worker"))
    tables = home.__dict__.setdefault("tables", {})
    if path not in tables:
        tables[path] = PieceTable(path)
    return tables[path]


def _regular(raw: bytes) -> str | None:
    """The piece in the form that the normaliser gives it, or None where only the whole tokenizer will do."""
    try:
        s = raw.decode()
    except UnicodeDecodeError:
        return None
    low = s.lower()
    ok = s.isalpha() and low.isalpha() and len(low) == len(s) and "Σ" not in s and unicodedata.is_normalized("NFC", s) and unicodedata.is_normalized("NFC", low)
    return low if ok else None


def encode(data: np.ndarray, offs: np.ndarray, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each document followed by ``end_id``, and where each document's begin (one more than documents)."""
    table = piece_table(path)
    if table.slots.used > TABLE_MOST:
        table.clear()
    n_docs = len(offs) - 1
    low = K.LOWER[data]
    cls = _CLASS[data]
    edge = np.ones(len(data) + 1, bool)
    if len(data):
        edge[1:-1] = (cls[1:] != cls[:-1]) | (cls[1:] == 3)
        edge[offs] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    keep = cls[starts] != 0 if len(data) else np.zeros(0, bool)
    starts, ends = starts[keep], ends[keep]
    prefix = K.prefix_hash(low)
    keys = K.span_hash(prefix, starts, ends)
    # pieces with bytes over 127 that were found irregular, and chunks that hold one, an apostrophe or "<|"
    has_wide = np.bitwise_or.reduceat(data, starts) >= 128 if len(starts) else np.zeros(0, bool)
    entry = table.find(keys)
    new_keys, first = np.unique(keys[entry < 0], return_index=True)
    first = np.flatnonzero(entry < 0)[first]
    fresh = ~np.isin(new_keys, table.odd_keys)
    new_keys, first = new_keys[fresh], first[fresh]
    texts, good, odd = [], [], []
    blob = low.tobytes()
    for i, (s, e, w) in enumerate(zip(starts[first].tolist(), ends[first].tolist(), has_wide[first].tolist(), strict=True)):
        t = _regular(blob[s:e]) if w else blob[s:e].decode()
        if t is None:
            odd.append(i)
        else:
            good.append(i)
            texts.append(t)
    if good:
        table.learn_plain(new_keys[good], texts)
    if odd:
        table.odd_keys = np.union1d(table.odd_keys, new_keys[odd])
    if good:
        entry = table.find(keys)
    bad = entry < 0
    mark = np.flatnonzero(data == 39)
    pipe = np.flatnonzero(data[:-1] == 60)
    mark = np.concatenate([mark, pipe[data[pipe + 1] == 124]])
    if len(mark):
        bad[np.searchsorted(starts, mark, side="right") - 1] = True
    if bad.any():
        c_start, c_end = K.word_spans(data, offs)
        chunk = np.searchsorted(c_start, starts, side="right") - 1
        bad_chunk = np.unique(chunk[bad])
        in_bad = np.isin(chunk, bad_chunk)
        raw = K.prefix_hash(data, K.BYTE_VALUE_2)  # case kept, other values: a key of its own
        c_keys = K.span_hash(raw, c_start[bad_chunk], c_end[bad_chunk])
        missing, at = np.unique(c_keys[table.find(c_keys) < 0], return_index=True)
        at = np.flatnonzero(table.find(c_keys) < 0)[at]
        if len(missing):
            blob = data.tobytes()
            table.learn_whole(missing, [blob[s:e].decode(errors="replace") for s, e in zip(c_start[bad_chunk][at].tolist(), c_end[bad_chunk][at].tolist(), strict=True)])
        starts = np.concatenate([starts[~in_bad], c_start[bad_chunk]])
        keys = np.concatenate([keys[~in_bad], c_keys])
        order = np.argsort(starts, kind="stable")
        starts, keys = starts[order], keys[order]
        entry = table.find(keys)
    # one more "piece" per document, at its end, holds the end id
    sizes = table.first[entry + 1] - table.first[entry]
    doc = K.doc_of(offs, starts)
    per_doc = np.bincount(doc, sizes, n_docs).astype(np.int64) + 1
    begins = np.concatenate([[0], np.cumsum(per_doc)])
    out = np.full(begins[-1], end_id, np.int32)
    at = np.cumsum(sizes) - sizes + doc  # each earlier document has added one end id
    shift = np.repeat(at - (np.cumsum(sizes) - sizes), sizes)
    source = np.repeat(table.first[entry] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(shift))
    out[np.arange(len(shift)) + shift] = table.ids[source]
    return out, begins


K.ship(__name__)
