"""What mixing gives, by plain loops: streams, a multinomial by its seed, a Feistel walk written out."""

import numpy as np
import tiktoken

from scriptorium.llm import bpe

ENC = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.VOCABULARY), special_tokens={})


def tokens(text):
    return ENC.encode_ordinary(text or "")


def splitmix(x, k):
    x = (x + 0x9E3779B97F4A7C15 * (k + 1)) % 2**64
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB % 2**64
    return x ^ (x >> 31)


def place(j, n, key):
    bits = 0
    while 4**bits < max(n, 2):
        bits += 1
    while True:
        a, b = j >> bits, j % 2**bits
        for k in range(4):
            a, b = b, a ^ (splitmix(b ^ splitmix(key, k), k + 9) % 2**bits)
        j = a << bits | b
        if j < n:
            return j


def mixed_plainly(rows, length, slots, seed, buckets, power=0.7):
    """Slots (shard, slot, source, epoch, block) and blocks by source, of rows (id, text, source, hash). A block is a list of (row, place, token)."""
    streams = {}
    for i, (_, text, source, _) in sorted(enumerate(rows), key=lambda r: (r[1][3] % buckets, r[1][0] is not None, r[1][0], r[1][3])):
        streams.setdefault(source, []).extend((i, p, t) for p, t in enumerate(tokens(text)))
    streams = {s: x for s, x in streams.items() if x}
    names = sorted(streams, key=lambda s: "null" if s is None else f"={s}")
    blocks = {s: [x[i : i + length] for i in range(0, len(x), length)] for s, x in streams.items()}
    weight = np.array([len(streams[s]) ** power for s in names])
    total, out, used = sum(map(len, blocks.values())), [], [0] * len(names)
    for shard in range(-(-total // slots)):
        full, within = min(slots, total - shard * slots), 0
        for s, n in enumerate(np.random.default_rng((seed, shard)).multinomial(full, weight / weight.sum())):
            for _ in range(n):
                size = len(blocks[names[s]])
                epoch, at = divmod(used[s], size)
                out.append((shard, place(within, full, splitmix(shard, seed + 2)), names[s], epoch, place(at, size, splitmix(s, seed) ^ splitmix(epoch, seed + 1))))
                used[s] += 1
                within += 1
    return out, blocks


def parts(block, rows):
    """(row, text) of the documents' parts in a block; a character goes where its first byte is."""
    out = []
    for row in dict.fromkeys(i for i, _, _ in block):
        own = [(p, t) for i, p, t in block if i == row]
        data = [ENC.decode_single_token_bytes(t) for t in tokens(rows[row][1])]
        whole = b"".join(data)
        lo, hi = len(b"".join(data[: own[0][0]])), len(b"".join(data[: own[-1][0] + 1]))

        def lead(at):
            while at < len(whole) and whole[at] & 0xC0 == 0x80:
                at += 1
            return at

        out.append((row, whole[lead(lo) : lead(hi)].decode()))
    return out
