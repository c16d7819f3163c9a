"""Token ids of whole texts: the tokenizers library on distinct pre-tokens, gathered with numpy.

Words repeat, so a text is cut at blanks, each distinct piece of a batch into pre-tokens (with the pattern
of the vocabulary), and the library encodes each distinct pre-token once. The ids of a text are those of its
pre-tokens in order (tested against whole-text encoding). Texts with other white space than single blanks
and line ends, with characters beyond Latin Extended-B, or with what could be a special token are encoded
whole by the library.

Memory is bounded in bytes: two caches of ``CACHE_BYTES``, and texts beyond ``LONG`` characters are cut first, where no
pre-token can reach across: before white space behind another character, or between a letter and a sentence mark. Only a
run without any such place (letters alone, say) goes to the library in one piece, whatever its length.
"""

from __future__ import annotations

import json
import os
import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from llm.common import release_worker

#: The pre-token patterns of the two kinds of public vocabularies.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Texts that are encoded whole: white space beside white space or at an end, rare characters, special tokens.
#: Longer texts (in characters) are cut; no call of the library gets much more.
LONG = 200_000
CACHE_BYTES = 12 << 20
#: Places where no pre-token reaches across, and no special token (they hold neither blanks nor these marks).
#: With the word pattern each digit is a pre-token of its own.
BORDER = r"(?<=\S)(?=\s)|(?<=\p{L})(?=[,.;:!?。、，．！？；：])"
BYTE_BORDER, WORD_BORDER = regex.compile(BORDER), regex.compile(BORDER + r"|(?<=\p{N})(?=\p{N})")

WHOLE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}]{2}|^[\s\x0b\x1c-\x1f\x{85}\x{a0}]|[\s\x0b\x1c-\x1f\x{85}\x{a0}]$|[^\x{00}-\x{24f}]|<\|"


class IdStore:
    """Ids of strings in one growing array. The strings are one Arrow array, bounded in bytes; two arrays say where the ids of
    each begin and how many they are."""

    #: Of an entry beside its characters and ids: an offset and two array places.
    ENTRY_BYTES = 24

    def __init__(self, encode, most_bytes: int):
        self.encode, self.most_bytes, self.bytes = encode, most_bytes, 0
        self.strings = pa.array([], pa.large_string())
        self.at, self.size = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def find(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of the ids of each (distinct) string."""
        numbers = pc.index_in(strings, value_set=self.strings)
        missing = np.flatnonzero(np.asarray(numbers.is_null()))
        numbers = numbers.fill_null(0).to_numpy()
        at, size = self.at[numbers], self.size[numbers]
        if len(missing):
            new = strings.take(pa.array(missing))
            flat, count = self.encode(new)
            if self.used + len(flat) > len(self.ids):
                self.ids = np.concatenate([self.ids[: self.used], np.zeros(len(flat) + min(len(self.ids), 1 << 20), np.uint32)])
            self.ids[self.used : self.used + len(flat)] = flat
            at[missing], size[missing] = self.used + np.cumsum(count) - count, count
            known, room = len(self.strings), 0
            if self.bytes < self.most_bytes:
                entry = np.cumsum(np.asarray(pc.binary_length(new)) + self.ENTRY_BYTES + 4 * count)
                room = int(np.searchsorted(entry, self.most_bytes - self.bytes, "right"))
                self.bytes = self.bytes + int(entry[room - 1]) if room == len(new) else self.most_bytes
            if known + room > len(self.at):
                more = np.zeros(room + min(known, 1 << 18), np.int64)
                self.at, self.size = np.concatenate([self.at[:known], more]), np.concatenate([self.size[:known], more])
            kept = missing[:room]
            self.at[known : known + room], self.size[known : known + room] = at[kept], size[kept]
            if room:
                self.strings = pa.concat_arrays([self.strings, new.slice(0, room)])
            # what found no room is overwritten by the next call
            self.used += int(count[:room].sum())
        return at, size


class TextEncoder:
    """``ids(texts)`` gives the ids of all texts, one after the other, and how many each text has."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES, long: int = LONG):
        from tokenizers import Tokenizer

        # a task has one core; the library's threads would only wait for work there
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as file:
            model = json.load(file)["model"]
        suffix = model["end_of_word_suffix"]
        self.words = bool(suffix)  # ends of words are seen in the ids, and white space has none
        self.pattern = regex.compile(WORD_PATTERN if self.words else BYTE_PATTERN)
        self.is_end = np.zeros(1 + max(model["vocab"].values()), bool)
        self.is_end[[i for t, i in model["vocab"].items() if t.endswith(suffix)] if self.words else model["vocab"]["\u010a"]] = True
        self.tokens = IdStore(self.encode_new, cache_bytes)
        self.pieces = IdStore(self.encode_pieces, cache_bytes)
        self.long = long

    def encode_whole(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text by the library, a bounded number of characters at a time."""
        out: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            end, held = at + 1, len(texts[at])
            while end < len(texts) and held + len(texts[end]) <= self.long:
                held += len(texts[end])
                end += 1
            out += [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts[at:end], add_special_tokens=False)]
            at = end
        return out

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = texts.cast(pa.large_string()).fill_null("")
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        long = np.flatnonzero(np.asarray(pc.utf8_length(texts)) > self.long)
        if not len(long):
            return self.short_ids(texts)
        runs, counts, at = [], np.zeros(len(texts), np.int64), 0
        for i in [*long.tolist(), len(texts)]:
            if i > at:
                flat, counts[at:i] = self.short_ids(texts.slice(at, i - at))
                runs.append(flat)
            if i < len(texts):
                before = len(runs)
                runs += self.long_ids(texts[i].as_py())
                counts[i] = sum(map(len, runs[before:]))
            at = i + 1
        return np.concatenate(runs), counts

    def long_ids(self, text: str):
        """Ids of one long text, part by part."""
        at = 0
        while at < len(text):
            end = border(text, at, at + self.long, WORD_BORDER if self.words else BYTE_BORDER)
            part = text[at:end]
            if self.words or not at or part[0] != " ":
                yield self.short_ids(pa.array([part], pa.large_string()))[0]
            else:
                # as in the middle of a text: the blank belongs to the first piece
                yield self.short_ids(pa.array([part[1:]], pa.large_string()), True)[0] if part[1:2].strip() else self.encode_whole([part])[0]
            at = end

    def short_ids(self, texts: pa.Array, inner: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """``inner``: the texts stand behind a blank."""
        whole = pc.match_substring_regex(texts, WHOLE)
        if inner and pc.any(whole).as_py():
            return self.short_ids(pa.array([" " + t for t in texts.to_pylist()], pa.large_string()))
        parts = pc.split_pattern(pc.if_else(whole, "", texts), " ")
        per_text = np.asarray(pc.list_value_length(parts)).astype(np.int64)
        coded = pc.list_flatten(parts).dictionary_encode()
        known = coded.dictionary
        code = coded.indices.to_numpy().astype(np.int64)
        # a piece that is not the first of its text begins with the blank it was cut at
        first = np.cumsum(per_text) - per_text
        heads, place = np.unique(code[first], return_inverse=True)
        if inner:
            heads, place = heads[:0], code[first] - len(known)
        code[first] = len(known) + place
        behind = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), known, pa.scalar(" ", pa.large_string()))
        at, size = self.pieces.find(pa.concat_arrays([behind, known.take(pa.array(heads))]))
        length = size[code]
        out = self.pieces.ids[ranges(at[code], length)]
        counts = np.add.reduceat(length, first)
        if not pc.any(whole).as_py():
            return out, counts
        rows = np.flatnonzero(np.asarray(whole))
        own = dict(zip(rows.tolist(), self.encode_whole(texts.take(pa.array(rows)).to_pylist()), strict=True))
        at = np.cumsum(counts) - counts
        runs = [own[i] if i in own else out[at[i] : at[i] + counts[i]] for i in range(len(counts))]
        return np.concatenate(runs), np.array([len(r) for r in runs], np.int64)

    def encode_pieces(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        pieces = new.to_pylist()
        if self.words:
            # below U+0250 every text is in NFC already, and lower case does not look at neighbours
            pieces = "<|".join(pieces).lower().split("<|")
        found = [self.pattern.findall(p) for p in pieces]
        per_piece = np.array([len(f) for f in found], np.int64)
        coded = pa.array([t for f in found for t in f], pa.large_string()).dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64)
        at, size = self.tokens.find(coded.dictionary)
        length = size[code]
        flat = self.tokens.ids[ranges(at[code], length)]
        ends = np.concatenate([[0], np.cumsum(length)])[np.cumsum(per_piece)]
        return flat, np.diff(ends, prepend=0)

    def encode_new(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self.encode_pretokens(new.to_pylist())

    def encode_pretokens(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All in a few long texts: one call for each would cost more than the work itself."""
        alone = [i for i, t in enumerate(tokens) if len(t) > 100_000 or not self.words and "\n" in t]
        if alone:
            runs: list = [None] * len(tokens)
            for i, ids in zip(alone, self.encode_whole([tokens[i] for i in alone]), strict=True):
                runs[i] = ids
            rest = [i for i in range(len(tokens)) if runs[i] is None]
            if rest:
                flat, size = self.encode_pretokens([tokens[i] for i in rest])
                for i, ids in zip(rest, np.split(flat, np.cumsum(size)[:-1]), strict=True):
                    runs[i] = ids
            return np.concatenate(runs), np.array([len(r) for r in runs], np.int64)
        step, out, sizes = 5000, [], []
        for i in range(0, len(tokens), step):
            group = tokens[i : i + step]
            flat = self.encode_whole(["\n".join(group) + ("" if self.words else "\n.")])[0]
            if not self.words:
                flat = flat[:-1]
            ends = np.flatnonzero(self.is_end[flat])
            if len(ends) != len(group):
                runs = self.encode_whole(group)
                out += runs
                sizes += [len(r) for r in runs]
                continue
            size = np.diff(ends, prepend=-1)
            out.append(flat if self.words else np.delete(flat, ends))
            sizes += (size if self.words else size - 1).tolist()
        return np.concatenate(out), np.array(sizes, np.int64)


def border(text: str, at: int, most: int, places_of=BYTE_BORDER) -> int:
    """The last place up to ``most`` where the text can be cut, or else the first one behind it, or the end."""
    if most >= len(text):
        return len(text)
    low = max(at + 1, most - 2000)
    while True:
        places = [m.start() for m in places_of.finditer(text, low, most + 1) if m.start() > at]
        if places:
            return places[-1]
        if low == at + 1:
            break
        low = max(at + 1, most - 8 * (most - low))
    found = places_of.search(text, most)
    return found.start() if found else len(text)


def worker_encoder(path: str) -> TextEncoder:
    """The encoder of this Python worker: words seen in one task need not be encoded again in the next."""
    state = sys.modules.setdefault("llm_worker_state", types.ModuleType("llm_worker_state"))
    encoders = state.__dict__.setdefault("encoders", {})
    if path not in encoders:
        encoders.clear()
        encoders[path] = TextEncoder(path)
        release_worker(encoders=False)  # reading the vocabulary takes more than keeping it
    return encoders[path]


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (length[0] of them), start[1], ... as one array."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(length) - length
    return np.repeat(start - before, length) + np.arange(total)
