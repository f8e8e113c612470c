"""Token ids of whole texts by a public tokenizer file, with a bounded cache of white-space-free chunks.

The word tokenizer drops white space and never joins text across it, so the
ids of a text are those of its chunks one after another. A chunk is what lies
between ASCII white space; anything else is left to the tokenizer. Arrow splits
a group of texts and finds its distinct chunks; only those are looked up, and
ids are gathered in numpy. Texts with a special token's opening go to the
tokenizer whole. Texts are never cut: a very long one is a group of its own.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks in each of the two generations that a Python worker keeps (some 40 MB together).
CACHE = 150_000
#: Characters of the texts that are encoded together, about.
GROUP = 1 << 21
#: How byte-level vocabularies write the bytes that aren't printable: as the characters from 256 on, in order.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_SHOWN = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}
_PROBES = ("word", "straße", "mañana", "éùçàü", "qxzjwv", "a")
#: Closing marks that the tokenizer splits from letters before them, as one run.
_MARKS = ".,;:!?)"


def default_path() -> str:
    """The tokenizer file that is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _plain(text: str) -> bool:
    """Whether all characters come before U+0100, where lower case is plain and normalisation changes nothing."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _strings(column: pa.Array) -> list[str]:
    """The column's strings; ``to_pylist`` makes a scalar of each first and takes ten times as long."""
    return column.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    """A tokenizer file with the ids of chunks seen lately: two generations, the older one dropped when the younger is full."""

    def __init__(self, path: str, width: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model, self.width = Tokenizer.from_file(path), width
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.letter = {"<u2": "H", "<u4": "I"}[width]
        #: Whether a word of letters is one piece to the model itself, so that nothing needs to be split or normalised.
        self.direct = all(self._word(w) == self._whole(w) for w in _PROBES)

    def _word(self, word: str) -> bytes:
        """The ids of a lower-case word of letters, as the model makes them of its bytes."""
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(_SHOWN)
        return array(self.letter, [t.id for t in self.model.model.tokenize(shown)]).tobytes()

    def _whole(self, text: str) -> bytes:
        return array(self.letter, self.model.encode(text, add_special_tokens=False).ids).tobytes()

    def _ids(self, parts: list[str]) -> list[bytes]:
        """The ids of distinct parts; only those that aren't kept go to the tokenizer."""
        found = list(map(self.young.get, parts))
        fresh = []
        for i, x in enumerate(found):
            if x is None:
                x = self.old.get(parts[i])
                if x is None:
                    fresh.append(i)
                else:
                    found[i] = self.young[parts[i]] = x
        others = []
        for i in fresh:
            if self.direct and parts[i].isalpha() and _plain(parts[i]):
                found[i] = self._word(parts[i].lower())
            else:
                others.append(i)
        for i, got in zip(others, self.model.encode_batch_fast([parts[i] for i in others], add_special_tokens=False), strict=True):
            found[i] = array(self.letter, got.ids).tobytes()
        for i in fresh:
            self.young[parts[i]] = found[i]
            if len(self.young) >= CACHE:
                self.old, self.young = self.young, {}
        return found

    def _group(self, texts: list[str], plain: bool) -> list[bytes]:
        """The ids of each of some texts without special tokens. ``plain`` texts may be lower-cased beforehand."""
        split = pc.ascii_split_whitespace(pa.array([t.lower() for t in texts] if plain else texts, pa.large_string()))
        at = np.asarray(split.offsets)
        coded = split.values.dictionary_encode()
        place, chunks = np.asarray(coded.indices), coded.dictionary
        pieces, parts = place, chunks
        if plain:
            # The tokenizer splits closing marks from a word of letters, so both are looked up by themselves.
            base = pc.utf8_rtrim(chunks, characters=_MARKS)
            cut = np.asarray(pc.and_(pc.utf8_is_alpha(base), pc.not_equal(base, chunks)))
            tails = [c[n:] for c, n in zip(_strings(chunks.filter(cut)), pc.utf8_length(base.filter(cut)).to_numpy(), strict=True)]
            tail = np.full(len(chunks), "", dtype=object)
            tail[cut] = tails
            both = pa.concat_arrays([pc.if_else(cut, base, chunks), pa.array(tail, pa.large_string())]).dictionary_encode()
            parts, code = both.dictionary, np.asarray(both.indices)
            pieces = np.stack([code[: len(chunks)][place], code[len(chunks) :][place]], axis=1).ravel()
            at = 2 * at
        found = self._ids(_strings(parts))
        data = np.frombuffer(b"".join(found), self.width)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // np.dtype(self.width).itemsize
        starts = np.cumsum(sizes) - sizes
        n = sizes[pieces]
        upto = np.r_[0, np.cumsum(n)]
        ids = data[np.repeat(starts[pieces] - upto[:-1], n) + np.arange(upto[-1])]
        cuts = upto[at - at[0]]
        return [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """For each text its ids as little-endian numbers; null is empty."""
        out: list[bytes] = [b""] * len(texts)
        held: dict[bool, list[int]] = {True: [], False: []}
        size = {True: 0, False: 0}

        def close(plain: bool) -> None:
            for i, ids in zip(held[plain], self._group([texts[i] for i in held[plain]], plain), strict=True):
                out[i] = ids
            held[plain], size[plain] = [], 0

        for i, text in enumerate(texts):
            if text and "<|" in text:
                out[i] = self._whole(text)
            elif text:
                plain = _plain(text)
                held[plain].append(i)
                size[plain] += len(text)
                if size[plain] >= GROUP:
                    close(plain)
        for plain in held:
            if held[plain]:
                close(plain)
        return out


_loaded: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, width: str = "<u4") -> Encoder:
    """The encoder of a file and a numpy type, loaded once for each Python worker, which keeps one."""
    if (path, width) not in _loaded:
        _loaded.clear()
        _loaded[path, width] = Encoder(path, width)
    return _loaded[path, width]


def vocabulary_size(path: str) -> int:
    """How many ids a tokenizer file has."""
    return encoder(path).model.get_vocab_size()
