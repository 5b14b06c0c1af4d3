"""Byte-level BPE by forced-boundary splitting.

A byte pair that never stands inside any token of the vocabulary marks a certain cut:
no merge can ever cross it. Texts are cut at the tokenizer's own pre-token borders and
at all forced borders; the resulting fragments are encoded independently and the ids
are concatenated. Fragments repeat, so each distinct one is encoded once per worker
and looked up by a 64-bit hash from then on, and its bytes are compared with those of the
fragment that was encoded; borders, lookups and comparisons are vectorised.

Files come from a public tokenizer whose path is a parameter; nothing is trained here.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np

from .textbytes import ragged, same_bytes, span_hashes

_LETTER, _NUMBER, _BLANK, _OTHER = 0, 1, 2, 3


def _classes() -> np.ndarray:
    """Letter, number, white space or other, for every code point."""
    out = np.full(0x110000, _OTHER, dtype=np.uint8)
    category = unicodedata.category
    for c in range(0x110000):
        k = category(chr(c))[0]
        if k == "L":
            out[c] = _LETTER
        elif k == "N":
            out[c] = _NUMBER
    # The Unicode White_Space property.
    out[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _BLANK
    return out


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in character of each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Encoder and decoder of one tokenizer file (tokenizers JSON, byte-level BPE, GPT-2 pre-tokens)."""

    #: Distinct fragments that a worker keeps; beyond that its table is built anew.
    MOST_KEPT = 1_500_000

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = _byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        vocab = {raw(t): i for t, i in spec["model"]["vocab"].items() if all(c in alphabet for c in t)}
        self.special = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.rank = {(raw(a), raw(b)): k for k, (a, b) in enumerate(merges)}
        self.vocab = vocab
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for t, i in vocab.items():
            self.token_bytes[i] = t
        for t, i in self.special.items():
            vocab.pop(t.encode(), None)
            self.token_bytes[i] = t.encode()
        self.token_text = [f"{i}," for i in range(size)]
        inside = np.zeros(65536, dtype=bool)
        for t in vocab:
            if len(t) > 1:
                b = np.frombuffer(t, dtype=np.uint8).astype(np.int64)
                inside[b[:-1] * 256 + b[1:]] = True
        self.forced = ~inside
        self.classes = _classes()
        self.core = self._fast_core()
        self._reset()

    def _fast_core(self):
        """A compiled merger for single fragments, when ids are in order of merging; else None."""
        order = [self.vocab.get(a + b, -1) for a, b in self.rank]
        if any(x >= y for x, y in zip(order, order[1:])):
            return None
        try:
            import tiktoken
        except ImportError:
            return None
        return tiktoken.Encoding("fragments", pat_str=r"[\s\S]+", mergeable_ranks=dict(self.vocab), special_tokens={})._core_bpe

    def _reset(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.places = np.zeros(0, dtype=np.int64)
        self.starts = np.zeros(1, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.int32)
        # the bytes of each encoded fragment
        self.pool = np.zeros(0, dtype=np.uint8)
        self.pool_starts = np.zeros(1, dtype=np.int64)

    def merge(self, fragment: bytes) -> list[int]:
        """Ids of one fragment, by merging the pair of lowest rank until none is left."""
        if self.core is not None:
            return self.core.encode_single_piece(fragment)
        parts = [fragment[i : i + 1] for i in range(len(fragment))]
        while len(parts) > 1:
            ranks = [self.rank.get(p, 1 << 60) for p in zip(parts, parts[1:])]
            best = min(ranks)
            if best == 1 << 60:
                break
            merged, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and ranks[i] == best:
                    merged.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    merged.append(parts[i])
                    i += 1
            parts = merged
        return [self.vocab[p] for p in parts]

    def borders(self, text: str, data: np.ndarray, points: np.ndarray) -> np.ndarray:
        """True at the first byte of each fragment. ``points``: code point offsets of the texts (joined in ``text``)."""
        n = len(text)
        code = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        kind = self.classes[code]
        head = np.zeros(n + 1, dtype=bool)
        head[points] = True
        start = head.copy()
        start[1:n] |= kind[1:] != kind[:-1]
        start[n] = True
        # a blank run before other text gives up its last blank: a plain space goes to that text
        blank = kind == _BLANK
        tail = np.flatnonzero(blank & start[1:] & ~head[1:])  # last blank, text follows
        start[tail] = True
        plain = tail[code[tail] == 32]
        start[plain + 1] = False
        # 's 't 'm 'd 're 've 'll, where scanning arrives at the apostrophe
        a = np.flatnonzero((code == 39) & start[:n])
        if len(a):
            padded = np.append(code, [0, 0, 0, 0])
            bound = np.searchsorted(points, a, side="right")
            room = points[bound] - a
            x, y = padded[a + 1], padded[a + 2]
            one = np.isin(x, [ord(c) for c in "stmd"]) & (room >= 2)
            two = (((x == 114) | (x == 118)) & (y == 101) | (x == 108) & (y == 108)) & (room >= 3) & ~one
            start[a[one] + 1] = False
            start[a[one] + 2] = True
            start[a[two] + 1] = False
            start[a[two] + 2] = False
            start[a[two] + 3] = True
        out = np.zeros(len(data) + 1, dtype=bool)
        if len(data) == n:
            out[: n + 1] = start
        else:
            width = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
            at = np.zeros(n + 1, dtype=np.int64)
            np.cumsum(width, out=at[1:])
            out[at[start]] = True
        if len(data) > 1:
            pair = data[:-1].astype(np.int32) * 256 + data[1:]
            out[1:-1] |= self.forced[pair]
        out[-1] = True
        return out

    def encode_joined(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, id offsets) of texts that stand one after another in ``data`` (UTF-8)."""
        texts = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(texts + 1, np.int64)
        text = data.tobytes().decode("utf-8")
        ids, ends = self._plain(text, data, offsets) if not any(s in text for s in self.special) else self._with_special(data, offsets)
        return ids, ends

    def _with_special(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts that hold a special token's string: they are split there and its id put in."""
        import re

        pattern = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
        raw, parts, owner = data.tobytes(), [], []
        for k in range(len(offsets) - 1):
            for p in pattern.split(raw[offsets[k] : offsets[k + 1]].decode("utf-8")):
                if p:
                    parts.append(p)
                    owner.append(k)
        plain = [b"" if p in self.special else p.encode() for p in parts]
        ends = np.concatenate([[0], np.cumsum([len(p) for p in plain])]).astype(np.int64)
        joined = b"".join(plain)
        ids, at = self._plain(joined.decode("utf-8"), np.frombuffer(joined, dtype=np.uint8), ends) if joined else (np.zeros(0, np.int32), np.zeros(len(parts) + 1, np.int64))
        pieces = [np.array([self.special[p]], np.int32) if p in self.special else ids[at[i] : at[i + 1]] for i, p in enumerate(parts)]
        counts = np.bincount(np.array(owner, dtype=np.int64), weights=[len(p) for p in pieces], minlength=len(offsets) - 1)
        return (np.concatenate(pieces) if pieces else np.zeros(0, np.int32)), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)

    def _plain(self, text: str, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(data) == len(text):
            points = offsets
        else:
            lead = (data & 0xC0) != 0x80
            at = np.zeros(len(data) + 1, dtype=np.int64)
            np.cumsum(lead, out=at[1:])
            points = at[offsets]
        cut = np.flatnonzero(self.borders(text, data, points))
        starts, ends = cut[:-1], cut[1:]
        hashes = span_hashes(data, starts, ends)
        place = self._places(hashes, data, starts, ends)
        size = self.starts[place + 1] - self.starts[place]
        group, k = ragged(size)
        ids = self.ids[self.starts[place][group] + k]
        before = np.zeros(len(place) + 1, dtype=np.int64)
        np.cumsum(size, out=before[1:])
        return ids, before[np.searchsorted(starts, offsets)]

    def _places(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where the ids of each fragment stand; encodes those not met before.

        A fragment whose bytes aren't those that its hash was first met with is encoded by itself.
        """
        if len(self.pool_starts) > self.MOST_KEPT:
            self._reset()
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, unique)
        new = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] != unique) if len(self.keys) else np.arange(len(unique))
        if len(new):
            found = self._encoded(data, starts[first[new]], ends[first[new]])
            self.keys = np.insert(self.keys, at[new], unique[new])
            self.places = np.insert(self.places, at[new], found)
        out = self.places[np.searchsorted(self.keys, unique)][inverse]
        size = ends - starts
        same = self.pool_starts[out + 1] - self.pool_starts[out] == size
        k = np.flatnonzero(same)
        same[k] = same_bytes(data, starts[k], self.pool, self.pool_starts[out[k]], size[k])
        odd = np.flatnonzero(~same)
        if len(odd):
            out[odd] = self._encoded(data, starts[odd], ends[odd])
        return out

    def _encoded(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Encodes and keeps fragments; their places."""
        raw = [data[s:e].tobytes() for s, e in zip(starts.tolist(), ends.tolist())]
        lists = [self.merge(x) for x in raw]
        base = len(self.starts) - 1
        flat = np.fromiter((i for x in lists for i in x), dtype=np.int32, count=sum(map(len, lists)))
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum([len(x) for x in lists])])
        self.ids = np.concatenate([self.ids, flat])
        self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(raw), dtype=np.uint8)])
        self.pool_starts = np.concatenate([self.pool_starts, self.pool_starts[-1] + np.cumsum([len(x) for x in raw])])
        return base + np.arange(len(raw))

    def encode(self, text: str) -> list[int]:
        data = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
        return self.encode_joined(data, np.array([0, len(data)]))[0].tolist()

    def decode(self, ids) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


_LOADED: dict[str, ByteBpe] = {}


def tokenizer(path: str) -> ByteBpe:
    """One encoder per file and worker process."""
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
