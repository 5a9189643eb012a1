"""Token ids of whole texts with the public byte-level BPE vocabulary.

The vocabulary cuts a text before it merges bytes: a single space between two characters that
are not white space starts a new piece, a single line feed is a piece, and a full stop or comma
after a letter or digit starts one. A text is cut at those places and the ids of each distinct
part are kept, so that the library sees a word once per worker and not once per occurrence.
Texts with other white space beside a space or line feed go to the library whole, and so do
texts that hold an added token such as the end-of-text string, which the library makes one id.
Both ways give the library's ids (``tests/llm/test_tokens_records_packing.py``).
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from triage.llm import common

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
# Parts kept per worker, in two generations: once the young one is full, it is the old one, and what
# is met again moves to the new young one. So frequent words stay and memory is bounded.
KEPT_PIECES = 500_000
KEPT_CHARS = 48  # longer parts are kept for their slice only
_ODD = re.compile("[\\s\u180e][ \n]|[ \n][\\s\u180e]|\\A[\\s\u180e]|(?:[^\\S\n]|\u180e)\\Z")
_PAIRS = ("  ", " \n", "\n ", "\n\n")
_NEWLINE = 198
_STOPS = frozenset(".,")
# Characters cut at a time, and characters of new parts in one text for the library.
_SLICE = 4_000_000
_JOINED = 8_000


def _odd(text: str) -> bool:
    """Whether white space stands where the cuts are not the vocabulary's."""
    if text.replace("\n", "").isprintable():  # then the only white space is space and line feed
        return text[:1] in (" ", "\n") and text != "" or text[-1:] == " " or any(p in text for p in _PAIRS)
    return _ODD.search(text) is not None


class Encoder:
    """Texts to ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        # texts that hold one of these as it stands go to the library whole
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.stops = {c: self._whole(c) for c in _STOPS}

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))

    def _uncut(self, text: str) -> bool:
        return _odd(text) or any(t in text for t in self.added)

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text, in order. A few megabytes of text are cut at a time."""
        held: list[str] = []
        size = 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size > _SLICE:
                yield from self._encode_slice(held)
                held, size = [], 0
        yield from self._encode_slice(held)

    def _encode_slice(self, held: list[str]) -> Iterator[bytes]:
        whole = [self._uncut(t) for t in held]
        cut = self._encode_cut([t for t, w in zip(held, whole, strict=True) if not w])
        for text, w in zip(held, whole, strict=True):
            yield self._whole(text) if w else next(cut)

    def _encode_cut(self, texts: list[str]) -> Iterator[bytes]:
        """Each distinct part is looked up once, and the ids are put together by places."""
        if not texts:
            return
        # a part stands for itself after a space, or after a line feed if it begins with one
        lines = pc.replace_substring(pa.array(texts, pa.string()), "\n", " \n")
        parts = pc.split_pattern(pc.binary_join_element_wise("\n", lines, ""), " ")
        coded = parts.flatten().dictionary_encode()
        ids = self._ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        own = np.frombuffer(b"".join(ids), dtype="<u4")
        codes = coded.indices.to_numpy()
        n = sizes[codes]
        ends = np.cumsum(n)
        out = own[np.repeat((np.cumsum(sizes) - sizes)[codes] - (ends - n), n) + np.arange(ends[-1])]
        bounds = np.append(0, ends)[parts.offsets.to_numpy()].tolist()
        for a, b in zip(bounds, bounds[1:], strict=False):
            yield out[a + 1 : b].tobytes()  # the line feed before a text is not part of it

    def _ids(self, parts: list[str]) -> list[bytes]:
        """The ids of distinct parts."""
        young, old = self.young, self.old
        ids: list[bytes | None] = list(map(young.get, parts))
        new = []
        for i in [i for i, known in enumerate(ids) if known is None]:
            known = old.get(parts[i])
            if known is None:
                new.append(i)
            else:
                young[parts[i]] = ids[i] = known
        for i, learned in zip(new, self._learn([parts[i] for i in new]), strict=True):
            ids[i] = learned
            if len(parts[i]) <= KEPT_CHARS:
                young[parts[i]] = learned
        if len(young) > KEPT_PIECES:
            self.old, self.young = young, {}
        return ids

    def _whole(self, text: str) -> bytes:
        ids = self.library.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def _learn(self, parts: list[str]) -> list[bytes]:
        """Ids of new parts, many in one text with a line feed before each."""
        stems: dict[str, bytes | None] = {}
        for part in parts:
            if part[-1:] in _STOPS and part[-2:-1].isalnum():
                stem = part[:-1]
                if stem not in stems:
                    stems[stem] = self.young.get(stem) or self.old.get(stem)
            else:
                stems[part] = None
        todo = [s for s, known in stems.items() if known is None]
        for stem in [s for s in todo if not s or s[-1] in "\n "]:
            stems[stem] = self._whole(stem if stem.startswith("\n") else " " + stem)
        todo = [s for s in todo if s and s[-1] not in "\n "]
        # short texts: the library's time grows faster than a text's length
        pile = np.cumsum(np.fromiter(map(len, todo), np.int64, len(todo)) + 2) // _JOINED
        cuts = [0, *(np.flatnonzero(np.diff(pile)) + 1).tolist(), len(todo)]
        blocks = [todo[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if a < b]
        joined = ["".join([s if s[0] == "\n" else "\n " + s for s in b]) for b in blocks]
        for block, coded in zip(blocks, self.library.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ids = np.array(coded.ids, dtype="<u4")
            begins = np.flatnonzero(ids == _NEWLINE)
            if len(begins) != len(block):
                raise ValueError("a line feed is not one id of its own in this vocabulary")
            raw, begins = ids.tobytes(), (begins * 4).tolist()
            for stem, begin, end in zip(block, begins, [*begins[1:], len(raw)], strict=True):
                stems[stem] = raw[begin:end] if stem[0] == "\n" else raw[begin + 4 : end]
        return [stems[p] if p in stems else stems[p[:-1]] + self.stops[p[-1]] for p in parts]


@common.worker_store
def encoder(path: str) -> Encoder:
    """One encoder per worker process."""
    return Encoder(path)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
