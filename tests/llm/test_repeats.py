"""Memory of a worker in op5's passes: bounded by some documents or windows, whatever the batch, the bucket and the digit."""

import numpy as np
import pyarrow as pa

from sentinela.llm import kernels, repeats

DEPTH = repeats.DEPTH


def test_hot_windows_of_a_large_batch_are_hashed_by_pieces():
    n, size = 3000, 2000
    text = np.random.RandomState(1).randint(97, 123, n * size, np.uint8).tobytes().decode()
    runs = [[{"first": 5, "last": 7, "at": 30, "digit": 9, "single": True, "hot": True}]] * n
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("at", pa.int32()), ("digit", pa.int64()), ("single", pa.bool_()), ("hot", pa.bool_())]))
    batch = pa.RecordBatch.from_arrays([pa.array([str(i).encode() for i in range(n)]), pa.array([text[i * size : (i + 1) * size] for i in range(n)]), pa.array(runs, kind)], names=["key", "text", "runs"])
    kernels._powers.clear()
    out = pa.Table.from_batches([b for b in repeats.bodies_of(batch, DEPTH)])
    assert out.num_rows == 3 * n and len(set(out.column("window_a").to_pylist())) == 3 * n
    assert max(map(len, kernels._powers.values())) <= 1 << 20


def bucket(rng, digits, runs, windows):
    rows = []
    for d in range(digits):
        common = rng.randint(97, 100, DEPTH + windows, np.uint8).tobytes()
        for r in range(runs):
            low, n = int(rng.randint(0, 40)), int(rng.randint(1, windows))
            body = bytearray(common[: n + DEPTH - 1] if r % 3 else rng.randint(97, 100, n + DEPTH - 1, np.uint8).tobytes())
            if r % 5 == 0:
                body[rng.randint(len(body))] = 33
            rows.append((f"{d}-{r}".encode(), bool(r % 7), d * 1001, low + windows + 20 + (r % 2), low, low + n - 1, bytes(body)))
    return pa.table([pa.array(c) for c in zip(*rows, strict=True)], names=["key", "single", "digit", "at", "low", "high", "body"])


def test_a_bucket_is_sorted_in_portions(monkeypatch):
    """Digits together, one digit by its places: the same stretches as brute force, and no large sort."""
    t = bucket(np.random.RandomState(4), 6, 40, 30)
    count, where = {}, []
    for r in t.to_pylist():
        for w in range(r["low"], r["high"] + 1):
            name = (r["digit"], r["at"] - w, r["body"][w - r["low"] : w - r["low"] + DEPTH])
            count[name] = count.get(name, 0) + 1
            where.append((r["key"], w, r["single"], name))
    want = {(k, w) for k, w, single, name in where if single and count[name] > 1}
    sizes, whole = [], repeats.radix_groups
    monkeypatch.setattr(repeats, "radix_groups", lambda data, starts, group, depth: sizes.append(len(starts)) or whole(data, starts, group, depth))
    for most in (100, 1000, 500_000):
        monkeypatch.setattr(repeats, "WINDOWS", most)
        sizes.clear()
        got = repeats.repeated_in_bucket(t, DEPTH).to_pylist()
        assert want and {(r["key"], w) for r in got for w in range(r["first"], r["last"] + 1)} == want
        assert max(sizes) <= most
