"""Token ids of whole texts with the tokenizers library, inside Arrow batches.

A byte-level BPE with the usual split pattern never merges across a space that
stands before a non-space, so a text's ids are those of its words, each with
the space before it. Words repeat: Arrow counts the distinct ones of a slice of
texts, a bounded cache holds their ids, only new words go to the library, and
the ids of the slice are gathered in one step. Caches end with their task.
"""
from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words of each of a cache's two generations, about 200 bytes each.
CACHE_WORDS = 300_000
#: The same of an encoder that ends with its task.
TASK_WORDS = 150_000
#: A space that is no border between words: before white space or at the end.
_UNUSUAL = re.compile(r" (?=\s|$|[\x1c-\x1f])")
_BORDER = re.compile(r" (?=\S)")


def split_words(text: str) -> list[str]:
    """Parts of a text such that " ".join gives it back and no token crosses a joint."""
    return _BORDER.split(text) if _UNUSUAL.search(text) else text.split(" ")


class WordCache:
    """bytes of the ids of a text, from those of its words. encode_words: words (with their spaces) -> bytes of ids each.

    When the young generation is full it becomes the old one, and words that are met again come back from there.
    """

    def __init__(self, encode_words: Callable[[list[str]], list[bytes]], limit: int = CACHE_WORDS):
        self.encode_words, self.limit, self.young, self.old = encode_words, limit, {}, {}

    def _add(self, words: set[str]) -> None:
        if len(self.young) + len(words) > self.limit:
            self.old, self.young = self.young, {}
        kept = words & self.old.keys()
        self.young.update((w, self.old[w]) for w in kept)
        new = list(words - kept)
        # a key that starts with a space is a first word: it has none before it
        self.young.update(zip(new, self.encode_words([w[1:] if w[0] == " " else " " + w for w in new])))

    def __call__(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        missing: list[tuple[int, list[str]]] = []
        get = self.young.get
        for i, text in enumerate(texts):
            parts = split_words(text)
            parts[0] = " " + parts[0]
            ids = list(map(get, parts))
            if None in ids:
                missing.append((i, parts))
                out.append(b"")
            else:
                out.append(b"".join(ids))
        if missing:
            young = self.young
            new: set[str] = set()
            for _, parts in missing:
                new.update(parts)
            wanted = new.difference(young)
            self._add(wanted)
            known = self.young if self.young is young else {**{w: young[w] for w in new - wanted}, **self.young}
            for i, parts in missing:
                out[i] = b"".join(map(known.__getitem__, parts))
        return out


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: The split pattern of byte-level vocabularies (fixed value), used on words of Latin letters only.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LATIN = re.compile("[\\x00-\u024f]*")


class LibraryEncoder:
    """Words -> little-endian ids by the model of a tokenizers.Tokenizer; one object per worker and file.

    Letters of a word are one piece and their marks others, so most pieces of a new word are known. Words with rare
    characters, which libraries may class differently, go through the tokenizer whole.
    """
    _loaded: dict[str, object] = {}  # tokenizers by file: their size is that of the vocabulary

    def __init__(self, vocab_path: str, dtype: str, limit: int = TASK_WORDS // 2):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer
        if vocab_path not in self._loaded:
            self._loaded[vocab_path] = Tokenizer.from_file(vocab_path)
            self._loaded[vocab_path].encode_special_tokens = True
        self.tokenizer = self._loaded[vocab_path]
        self.model, self.kind, self.letters = self.tokenizer.model, {2: "H", 4: "I"}[np.dtype(dtype).itemsize], _byte_letters()
        self.split, self.limit, self.pieces = regex.compile(_PIECES).findall, limit, {}

    def _piece(self, piece: str) -> bytes:
        mapped = piece.encode().decode("latin-1").translate(self.letters)
        ids = self.pieces[piece] = array(self.kind, [t.id for t in self.model.tokenize(mapped)]).tobytes()
        return ids

    def __call__(self, words: list[str]) -> list[bytes]:
        if len(self.pieces) > self.limit:
            self.pieces.clear()
        get, piece, split = self.pieces.get, self._piece, self.split
        out = []
        for w in words:
            if w[1:].isalpha() and w[0] == " ":
                out.append(get(w) or piece(w))
            elif _LATIN.fullmatch(w):
                out.append(b"".join([get(p) or piece(p) for p in split(w)]))
            else:
                out.append(array(self.kind, self.tokenizer.encode(w, add_special_tokens=False).ids).tobytes())
        return out


#: A blank before white space or at the end, for Arrow's regular expressions.
_ODD = " ($|[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}])"


class TextEncoder:
    """Ids of texts as bytes; one object per task.

    As loaded, an added token that a text spells out is that token, as for the tokenizer's own call; otherwise it is
    encoded as the ordinary characters it consists of.
    """

    def __init__(self, vocab_path: str, dtype: str, as_loaded: bool = False, limit: int = TASK_WORDS):
        self.words, self.limit, self.young, self.old = LibraryEncoder(vocab_path, dtype), limit, {}, {}
        self.dtype = np.dtype(dtype)
        added = self.words.tokenizer.get_added_tokens_decoder() if as_loaded else {}
        if any(t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("added tokens that take in their surroundings are not supported as loaded")
        self.added = {t.content: np.array([k], dtype).tobytes() for k, t in added.items()}
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=lambda t: (-len(t), t))) + ")") if added else None

    def __call__(self, texts: pa.Array | list[str]) -> list[bytes]:
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        marked = [pc.match_substring(texts, t) for t in self.added]
        rows = np.flatnonzero(np.logical_or.reduce([m.to_numpy(zero_copy_only=False) for m in marked])) if marked else []
        if not len(rows):
            return self._plain(texts)
        # the library cuts a text at added tokens first and treats the parts as texts of their own
        parts = [self.cut.split(texts[i].as_py()) for i in rows.tolist()]
        between = iter(self._plain(pa.array([p for own in parts for p in own[::2]], pa.string())))
        keep = np.ones(len(texts), bool)
        keep[rows] = False
        out = iter(self._plain(texts.filter(pa.array(keep))))
        of = dict(zip(rows.tolist(), parts))
        return [b"".join(self.added[p] if j % 2 else next(between) for j, p in enumerate(of[i])) if i in of else next(out) for i in range(len(texts))]

    def _plain(self, texts: pa.Array) -> list[bytes]:
        if not len(texts):
            return []
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._gathered(pc.split_pattern(texts, " "))
        odd_ids = iter(self._gathered(pa.array([split_words(t) for t in texts.filter(pa.array(odd)).to_pylist()], pa.list_(pa.string()))))
        others = texts.filter(pa.array(~odd))
        ids = iter(self._gathered(pc.split_pattern(others, " ")) if len(others) else [])
        return [next(odd_ids if o else ids) for o in odd.tolist()]

    def _known(self, keys: list[str]) -> list[bytes]:
        out = list(map(self.young.get, keys))
        missing = [i for i, x in enumerate(out) if x is None]
        if missing:
            old = self.old
            if len(self.young) + len(missing) > self.limit:
                self.old, self.young = self.young, {}
            new = []
            for i in missing:
                out[i] = old.get(keys[i])
                if out[i] is None:
                    new.append(i)
            # a key that starts with a blank is a first word: it has none before it
            for i, ids in zip(new, self.words([k[1:] if k[:1] == " " else " " + k for k in (keys[i] for i in new)])):
                out[i] = ids
            self.young.update((keys[i], out[i]) for i in missing)
        return out

    def _gathered(self, lists: pa.Array) -> list[bytes]:
        """Ids of texts given as lists of words: every distinct word is looked up once."""
        sizes = pc.list_value_length(lists).to_numpy()
        ends = np.cumsum(sizes)
        found = lists.flatten().dictionary_encode()
        codes, names = found.indices.to_numpy().astype(np.int64), found.dictionary.to_pylist()
        first, of = np.unique(codes[ends - sizes], return_inverse=True)
        codes[ends - sizes] = len(names) + of
        own = self._known(names + [" " + names[i] for i in first.tolist()])
        lengths = np.fromiter(map(len, own), np.int64, len(own)) // self.dtype.itemsize
        ids = np.frombuffer(b"".join(own), self.dtype)
        take = lengths[codes]
        after = np.cumsum(take)
        place = np.repeat((np.cumsum(lengths) - lengths)[codes] - (after - take), take)
        place += np.arange(len(place))
        made = ids[place].tobytes()
        bounds = np.concatenate([[0], after])[np.concatenate([[0], ends])] * self.dtype.itemsize
        return [made[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def arrow_slices(texts: pa.Array, size: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about so many bytes, one row at least."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size, "right")))
        yield start, stop
        start = stop


def slices(texts: list[str], chars: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about so many characters, one row at least."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
