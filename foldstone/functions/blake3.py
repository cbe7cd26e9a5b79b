"""BLAKE3 digests on executors, vectorised over the chunks of all values of a batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values of the published algorithm: initial words, and the order of message words from round to round
IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
ORDER = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
START, END, PARENT, ROOT = 1, 2, 4, 8
CHUNK, BLOCK = 1024, 64


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def _mix(v: list, a: int, b: int, c: int, d: int, x: np.ndarray, y: np.ndarray) -> None:
    for m, r1, r2 in ((x, 16, 12), (y, 8, 7)):
        v[a] = v[a] + v[b] + m
        v[d] = _turn(v[d] ^ v[a], r1)
        v[c] = v[c] + v[d]
        v[b] = _turn(v[b] ^ v[c], r2)


def _compress(cv: np.ndarray, words: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Chaining values (n, 8) of n blocks (n, 16) at once."""
    n = len(words)
    full = lambda w: np.full(n, w, dtype=np.uint32)
    v = [cv[:, i] for i in range(8)] + [full(w) for w in IV[:4]] + [counter.astype(np.uint32), (counter >> np.uint64(32)).astype(np.uint32), length.astype(np.uint32), flags.astype(np.uint32)]
    m = [words[:, i] for i in range(16)]
    for _ in range(7):
        for k, (a, b, c, d) in enumerate(((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))):
            _mix(v, a, b, c, d, m[2 * k], m[2 * k + 1])
        m = [m[i] for i in ORDER]
    return np.stack([v[i] ^ v[i + 8] for i in range(8)], axis=1)


def digests(values: list[bytes]) -> list[str]:
    """64 hex digits for each value: the chunks of all values go through every block together, then the pairs of each level of all trees."""
    if not values:
        return []
    lengths = np.array([len(v) for v in values], dtype=np.int64)
    chunks = np.maximum(1, -(-lengths // CHUNK))
    first = np.cumsum(chunks) - chunks
    padded = np.zeros(int(chunks.sum()) * CHUNK, dtype=np.uint8)
    for v, at in zip(values, (first * CHUNK).tolist(), strict=True):
        padded[at : at + len(v)] = np.frombuffer(v, dtype=np.uint8)
    words = padded.view("<u4").reshape(-1, CHUNK // BLOCK, 16)
    of = np.repeat(np.arange(len(values)), chunks)
    counter = (np.arange(len(of)) - first[of]).astype(np.uint64)
    sizes = np.minimum(CHUNK, lengths[of] - counter.astype(np.int64) * CHUNK)
    last = np.maximum(1, -(-sizes // BLOCK)) - 1
    cv = np.tile(np.array(IV, dtype=np.uint32), (len(of), 1))
    for b in range(int(last.max()) + 1):
        on = np.flatnonzero(last >= b)
        flags = np.where(b == 0, START, 0) + np.where(last[on] == b, END + np.where(chunks[of[on]] == 1, ROOT, 0), 0)
        cv[on] = _compress(cv[on], words[on, b], counter[on], np.clip(sizes[on] - b * BLOCK, 0, BLOCK), flags)

    count = chunks
    while (count > 1).any():  # one level: neighbours of one value pair up, an odd last node goes up as it is
        start = np.cumsum(count) - count
        of = np.repeat(np.arange(len(count)), count)
        place = np.arange(len(of)) - start[of]
        left = np.flatnonzero((place % 2 == 0) & (place + 1 < count[of]))
        joined = np.concatenate([cv[left], cv[left + 1]], axis=1)
        flags = PARENT + np.where(count[of[left]] == 2, ROOT, 0)
        cv[left] = _compress(np.tile(np.array(IV, dtype=np.uint32), (len(left), 1)), joined, np.zeros(len(left), dtype=np.uint64), np.full(len(left), BLOCK), flags)
        cv = cv[place % 2 == 0]
        count = (count + 1) // 2
    return [row.tobytes().hex() for row in cv.astype("<u4")]


def digest(data: bytes) -> str:
    return digests([data])[0]


#: Pairs of a start and an end that are hashed at once: few enough for the processor's cache, enough to outweigh NumPy's cost of a call.
AT_ONCE = 32_768
_SHIFTS = {n: (np.array(n, dtype=np.uint32), np.array(32 - n, dtype=np.uint32)) for n in (16, 12, 8, 7)}


def _mix_rows(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, t: np.ndarray, first: list, second: list) -> None:
    """The mixing of ``_mix`` in place, for all rows at once; a message word that is None is 0. ``t`` is room for a rotation."""
    for words, r1, r2 in ((first, 16, 12), (second, 8, 7)):
        np.add(a, b, out=a)
        for row, m in zip(a, words, strict=True):
            if m is not None:
                np.add(row, m, out=row)
        for x, y, add, n in ((d, a, None, r1), (b, d, c, r2)):
            if add is not None:
                np.add(add, y, out=add)
                y = add
            right, left = _SHIFTS[n]
            np.bitwise_xor(x, y, out=x)
            np.right_shift(x, right, out=t)
            np.left_shift(x, left, out=x)
            np.bitwise_or(x, t, out=x)


class Endings:
    """BLAKE3 of every text that is some start followed by one of ``ends``, as far as it takes to rank the ends of a start.

    What the texts of a start share is hashed once: the blocks before the last ones, and the first steps of the block in which the start ends. The rest
    goes through NumPy in place, in parts that stay in the cache, the four mixings of a step by the same calls.
    """

    def __init__(self, ends: list[bytes]) -> None:
        self.ends = ends
        self.room = np.empty(0, dtype=np.uint32)
        self.groups: list[tuple[int, np.ndarray, list[np.ndarray]]] = []
        lengths = np.array([len(v) for v in ends], dtype=np.int64)
        for size in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == size)
            text = np.frombuffer(b"".join(ends[i] for i in at), dtype=np.uint8).reshape(len(at), size)
            words = []
            for shift in range(4):  # the end's words, by its place in the first of them
                room = np.zeros((len(at), -(-(size + shift) // 4) * 4), dtype=np.uint8)
                room[:, shift : shift + size] = text
                words.append(np.ascontiguousarray(room.view("<u4").astype(np.uint32).T))
            self.groups.append((size, at, words))

    def high(self, starts: list[bytes]) -> np.ndarray:
        """Bytes 4 to 7 of each digest as a little-endian number, (starts, ends). All starts have one length."""
        out = np.empty((len(starts), len(self.ends)), dtype=np.uint32)
        for size, at, words in self.groups:
            n = len(starts[0])
            if n + size > CHUNK:
                out[:, at] = [[int.from_bytes(bytes.fromhex(x[8:16]), "little") for x in digests([s + self.ends[i] for i in at])] for s in starts]
                continue
            wide = -(-len(at) // -(-len(at) // AT_ONCE))  # parts of one size
            many = max(1, AT_ONCE // wide)
            for j in range(0, len(at), wide):
                part = [w[:, j : j + wide] for w in words]
                for i in range(0, len(starts), many):
                    out[i : i + many, at[j : j + wide]] = self._high(starts[i : i + many], n, size, part)
        return out

    def _high(self, starts: list[bytes], n: int, size: int, words: list[np.ndarray]) -> np.ndarray:
        """``high`` of starts of ``n`` bytes and of ends of ``size``, within one chunk."""
        k = len(starts)
        blocks = max(1, -(-(n + size) // BLOCK))
        shared = min(n // BLOCK, blocks - 1)
        text = np.zeros((k, blocks * BLOCK), dtype=np.uint8)
        text[:, :n] = np.frombuffer(b"".join(starts), dtype=np.uint8).reshape(k, n)
        own = text.view("<u4").astype(np.uint32)
        zero = np.zeros(k, dtype=np.uint64)
        state = np.tile(np.array(IV, dtype=np.uint32), (k, 1))
        for b in range(shared):
            state = _compress(state, own[:, b * 16 : b * 16 + 16], zero, np.full(k, BLOCK), np.full(k, START if b == 0 else 0))
        cv = [state[:, i : i + 1] for i in range(8)]
        message: list = [own[:, i : i + 1] if 4 * i < n else None for i in range(blocks * 16)]
        fresh = np.zeros(blocks * 16, dtype=bool)  # words that an end has a part in
        for i, w in enumerate(words[n % 4], n // 4):
            message[i] = w[None, :] if message[i] is None else message[i] | w[None, :]
            fresh[i] = True
        for b in range(shared, blocks):
            last = b == blocks - 1
            flags = (START if b == 0 else 0) | (END | ROOT if last else 0)
            cv = self._block(cv, message[b * 16 : b * 16 + 16], fresh[b * 16 : b * 16 + 16], n + size - b * BLOCK if last else BLOCK, flags, b == shared, last, (k, words[0].shape[1]))
        return cv[1]

    def _block(self, cv: list, m: list, fresh: np.ndarray, length: int, flags: int, same: bool, last: bool, shape: tuple[int, int]) -> list:
        """The chaining value of a block, of the ``last`` one word 1 alone. ``same``: ``cv`` has one column, the same for all ends."""
        if self.room.size < (size := 24 * shape[0] * shape[1]):
            self.room = np.empty(size, dtype=np.uint32)
        room = self.room[:size].reshape(24, *shape)
        # rows of b, c and d turn against those of a from step to step: instead, the rows that come round are copied to the other end
        a, b, c, d, t = room[:4], room[4:9], room[9:15], room[15:20], room[20:24]
        full = lambda w: np.full((shape[0], 1), w, dtype=np.uint32)
        v = [*cv, *(full(w) for w in (*IV[:4], 0, 0, length, flags))]
        done = 0  # mixings of the first step in which no end has a part
        while same and done < 4 and not fresh[2 * done : 2 * done + 2].any():
            _mix(v, done, done + 4, done + 8, done + 12, *(full(0) if w is None else w for w in m[2 * done : 2 * done + 2]))
            done += 1
        for i in range(4):
            for to, x in ((a[i], v[i]), (b[i], v[i + 4]), (c[i], v[i + 8]), (d[i + 1], v[i + 12])):
                np.copyto(to, x)
        for r in range(7):
            if r:
                done, m = 0, [m[i] for i in ORDER]
            if done < 4:
                _mix_rows(a[done:], b[done:4], c[done:4], d[done + 1 :], t[done:], m[2 * done : 8 : 2], m[2 * done + 1 : 8 : 2])
            np.copyto(b[4], b[0])
            np.copyto(c[4:], c[:2])
            np.copyto(d[0], d[4])
            if r == 6 and last:  # word 1 takes two of four mixings
                _mix_rows(a[1::2], b[2::2], c[3::2], d[1:4:2], t[:2], m[10::4], m[11::4])
                return [None, a[1] ^ c[5]]
            _mix_rows(a, b[1:], c[2:], d[:4], t, m[8::2], m[9::2])
            np.copyto(b[0], b[4])
            np.copyto(c[:2], c[4:])
            np.copyto(d[4], d[0])
        return [x.copy() for x in (*(a ^ c[:4]), *(b[:4] ^ d[1:]))]


#: Bytes, rounded up to chunks, that are laid out at once.
ROOM = 64 << 20


def blake3(c: Column | str) -> Column:
    """The BLAKE3 digest of a text or binary column; NULL for NULL."""

    def hashed(values: pa.Array) -> pa.Array:
        out, held, room = [], [], 0
        for v in values.drop_null().to_pylist():
            if held and room + len(v) + CHUNK > ROOM:
                out += digests(held)
                held, room = [], 0
            held.append(v)
            room += len(v) + CHUNK
        out = iter(out + digests(held))
        return pa.array([next(out) if ok else None for ok in values.is_valid().to_pylist()], pa.string())

    hashed.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return F.arrow_udf(hashed, "string")((F.col(c) if isinstance(c, str) else c).cast("binary"))
