"""Token ids from tokenizer files, inside tasks.

A tokenizer whose pieces never cross white space (word BPE) gives the same ids for a text as for its space-delimited
chunks one after another. So each worker keeps a bounded table from chunks to their ids, in which the library fills what
is new, and a text becomes one lookup a chunk. Texts with control characters that count as space in one definition but
not the other go to the library whole, as do all texts of other tokenizers.
"""

from __future__ import annotations

import re
import string
import struct

#: A worker's table has at most twice this many chunks, each of at most so many characters: some 100 MB.
CACHE_ENTRIES, LONGEST = 250_000, 48
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_NOT_PLAIN = re.compile("[^a-zA-ZÀ-ÖØ-öø-įı-ſ \\n.,;:!?]")
_TWO_MARKS = re.compile("[.,;:!?][.,;:!?]")
#: ASCII marks: a run of them after letters is a piece of its own.
MARKS = string.punctuation
_LATIN = re.compile("[a-zA-ZÀ-ÖØ-öø-įı-ſ]+")
_ENCODERS: dict[tuple[str, bool], Encoder] = {}


class _Chunks(dict):
    """chunk -> ids as little-endian unsigned 32-bit integers. When full it becomes the older of two generations."""

    def __init__(self, encode, encode_word):
        super().__init__()
        self.encode, self.encode_word, self.older = encode, encode_word, {}

    def __missing__(self, chunk: str) -> bytes:
        if len(chunk) > LONGEST:
            return self.encode(chunk)
        if len(self) >= CACHE_ENTRIES:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(chunk)
        if ids is None:
            core = chunk.rstrip(MARKS)
            if not _LATIN.fullmatch(core):
                ids = self.encode(chunk)
            elif core != chunk:  # letters and punctuation are pieces of their own
                ids = self[core] + self[chunk[len(core) :]]
            else:
                ids = self[low] if (low := chunk.lower()) != chunk else self.encode_word(chunk)
        self[chunk] = ids
        return ids


class Encoder:
    """The ids of texts by the tokenizers library, without begin, end or other added tokens."""

    def __init__(self, path: str, by_chunk: bool):
        import numpy as np
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.no_padding()
        library.no_truncation()
        self.library = lambda text: np.asarray(library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        self.chunks = None
        if by_chunk:
            from tokenizers.pre_tokenizers import ByteLevel

            as_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
            table = {ord(c): as_bytes.pre_tokenize_str(c)[0][0] for c in map(chr, range(0x41, 0x180)) if _LATIN.fullmatch(c)}
            tokenize, formats = library.model.tokenize, [f"<{n}I" for n in range(64)]

            def word(w: str) -> bytes:
                ids = [t.id for t in tokenize(w if w.isascii() else w.translate(table))]
                return struct.pack(formats[len(ids)] if len(ids) < 64 else f"<{len(ids)}I", *ids)

            self.chunks = _Chunks(self.library, word)

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.chunks is None or _ODD_SPACE.search(text):
            return self.library(text)
        if not _NOT_PLAIN.search(text) and not _TWO_MARKS.search(text):  # fewer kinds of chunks: each word in lower case and each mark by itself
            text = text.lower()
            for mark in ".,;:!?":
                text = text.replace(mark, f" {mark} ")
        return b"".join(map(self.chunks.__getitem__, text.split()))


def encoder(name: str, by_chunk: bool) -> Encoder:
    """The worker's encoder for a file of public_tokenizers, or for a path; made once a worker."""
    if (name, by_chunk) not in _ENCODERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        path = name
        if os.sep not in name:
            import public_tokenizers

            path = public_tokenizers.path(name)
        _ENCODERS[name, by_chunk] = Encoder(path, by_chunk)
    return _ENCODERS[name, by_chunk]
