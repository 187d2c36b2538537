"""Token ids of a public tokenizer file, with a bounded cache of what whitespace-separated chunks give.

The tokenizers handled here drop white space and never join tokens across it, so that a text's ids are those of its
chunks, one after the other. The chunks of many texts are told apart by Arrow, each distinct one is looked up once, and numpy
puts the ids in order. Chunks that are a letter sequence with punctuation behind it are composed of two entries; new
sequences of ASCII letters go straight to the model, others are encoded together in one call and told apart by the
end-of-word mark of their last token. Texts with a special token's string, or with characters on which Arrow and the
tokenizer differ about white space, are encoded whole by the tokenizer itself.
"""

from __future__ import annotations

import json
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")
_PUNCT = string.punctuation
#: Bytes of texts that are handled together.
_TOGETHER = 4 << 20
_encoders: dict = {}


class ChunkEncoder:
    """Ids of texts by a word-end BPE file; `limit` bounds the cache's entries."""

    def __init__(self, path: str, limit: int = 700_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.cache = Tokenizer.from_file(path), limit, {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        mark, vocab = spec["model"].get("end_of_word_suffix") or "", spec["model"]["vocab"]
        self.by_chunk = bool(mark)
        steps = spec.get("pre_tokenizer") or {}
        self.plain = [x.get("type") for x in steps.get("pretokenizers", [])] == ["Split", "ByteLevel"] and spec["model"]["type"] == "BPE"
        self.ends = np.zeros(max(vocab.values()) + 1 + len(spec["added_tokens"]), dtype=bool)
        if mark:
            self.ends[[i for s, i in vocab.items() if s.endswith(mark)]] = True

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _letters(self, words: list[str]) -> None:
        """Cache letter sequences, encoded in one call."""
        if not words:
            return
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, dtype="<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1 if len(ids) else ids
        if len(stops) != len(words) or stops[-1] != len(ids):
            for w in words:
                self.cache[w] = self.whole(w).tobytes()
            return
        raw, at = ids.tobytes(), 0
        for w, stop in zip(words, (stops * 4).tolist(), strict=True):
            self.cache[w] = raw[at:stop]
            at = stop

    def _learn(self, chunks: list[str]) -> None:
        """Cache chunks: letters with marks behind them by their parts, others as they are."""
        cache, cores = self.cache, pc.utf8_rtrim(pa.array(chunks, pa.large_string()), characters=_PUNCT)
        simple = pc.and_(pc.string_is_ascii(cores), pc.ascii_is_alpha(cores)).to_numpy(zero_copy_only=False).tolist()
        bodies = pc.if_else(pa.array(simple), pc.ascii_lower(cores), cores).to_numpy(zero_copy_only=False).tolist()
        letters = [ascii_letters or body.isalpha() for ascii_letters, body in zip(simple, bodies, strict=True)]
        for w, is_letters in zip(chunks, letters, strict=True):
            if not is_letters:
                cache[w] = self.whole(w).tobytes()
        fresh = {body for body, is_letters in zip(bodies, letters, strict=True) if is_letters and body not in cache}
        if self.plain:  # ASCII letters are themselves as bytes, and one piece for the model
            tokenize = self.tokenizer.model.tokenize
            for body in filter(str.isascii, fresh):
                cache[body] = b"".join([t.id.to_bytes(4, "little") for t in tokenize(body)])
            fresh = {body for body in fresh if not body.isascii()}
        others = sorted(fresh)
        for at in range(0, len(others), 4096):
            self._letters(others[at : at + 4096])
        for w, body, is_letters in zip(chunks, bodies, letters, strict=True):
            if is_letters and w != body:
                tail = w[len(body) :]
                if tail and tail not in cache:
                    cache[tail] = self.whole(tail).tobytes()
                cache[w] = cache[body] + cache[tail] if tail else cache[body]

    def _together(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without odd characters, and where each text's ids begin (and the last one's end)."""
        chunks = pc.utf8_split_whitespace(texts)
        coded = chunks.flatten().dictionary_encode()
        distinct, cache = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), self.cache
        if len(cache) > self.limit:
            cache.clear()
        pieces = list(map(cache.get, distinct))
        unknown = [k for k, piece in enumerate(pieces) if piece is None]
        if unknown:
            self._learn([distinct[k] for k in unknown])
            for k in unknown:
                pieces[k] = cache[distinct[k]]
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)) // 4
        code = coded.indices.to_numpy()
        count = sizes[code]
        before = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(count)])
        at = np.repeat((np.cumsum(sizes) - sizes)[code] - before[:-1], count) + np.arange(before[-1])
        offsets = chunks.offsets.to_numpy()
        return np.frombuffer(b"".join(pieces), dtype="<u4")[at], before[offsets - offsets[0]]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """For each text its ids as little-endian unsigned 32-bit integers; null is the empty text."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = np.zeros(len(texts), dtype=bool)
        for mark in _ODD:
            odd |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        odd |= not self.by_chunk
        plain = pc.if_else(pa.array(odd), "", texts)
        out: list[np.ndarray] = []
        ends, at = np.cumsum(pc.binary_length(texts).to_numpy()), 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _TOGETHER, side="right")))
            ids, begin = self._together(plain.slice(at, stop - at))
            out += [self.whole(texts[k].as_py()) if odd[k] else ids[begin[k - at] : begin[k - at + 1]] for k in range(at, stop)]
            at = stop
        return out


def encoder(path: str) -> ChunkEncoder:
    """This process's encoder of a file; workers that are used again keep its cache."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
