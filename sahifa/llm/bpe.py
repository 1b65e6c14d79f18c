"""BPE by a tokenization automaton.

States are tokens: the state after a token is the set of tokens that may follow it in a correct tokenization. The
automaton is what successive merge gadgets make of a one-state automaton over the base symbols. The gadget of merge
``u v -> uv`` takes the arc ``v`` out of the state of ``u``, gives the arc ``uv`` to every state that had an arc
``u``, and lets it lead where ``v`` led. Later gadgets only remove arcs between the tokens they merge. So an arc
``w -> x`` of the finished automaton is decided by undoing gadgets, the latest first: an arc into a merged token was
copied from the arc into its left part, an arc out of a merged token from the arc out of its right part, and no
gadget between may have taken it out. The arcs are compiled in that way when they are first asked for and then sit
in a transition table; the whole table would have tokens squared entries, of which a corpus uses few.

In the finished automaton each string has one path, its tokenization. A word is encoded from left to right: for each
prefix the table gives the one token that the path of the prefix ends with. Decoding emits the arcs' labels.

Words are cut as the tokenizer file's fixed pattern says: by ``re`` where a text keeps to code points on which
all Unicode versions agree, else by the tokenizers library's own normaliser and splitter. Defined cases: a null text is an empty one (no tokens); a
text of any length is encoded whole; repeated rows give repeated results; only the identifier and text columns are
read, so further columns may have any names and are not carried along.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from itertools import chain
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from sahifa.llm.arrow import field, map_slices

END = "</w>"
#: A code point outside Latin, basic Greek and Cyrillic, Arabic letters and general punctuation.
UNSETTLED = re.compile("[^\\x00-\u012f\u0131-\u024f\u0391-\u03a1\u03a3-\u03c9\u0400-\u045f\u0621-\u064a\u2010-\u2027\u20ac]")
#: What the classes of the fixed pattern are among the settled code points, for the standard library's ``re``.
LETTER, NUMBER, OTHER = r"[^\W\d_²³¹¼½¾]", r"[0-9²³¹¼½¾]", r"(?:[^\w\t-\r \x85\xa0]|_)"
#: Entries kept of the two tables that grow while encoding; either is emptied when full.
MAX_WORDS, MAX_ARCS = 500_000, 1_000_000


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where Latin-1 prints it, else the next code point from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


class MergeAutomaton:
    """The automaton of a list of merges; tokens are ids of ``vocab``."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.vocab, self.label = vocab, {i: t for t, i in vocab.items()}
        self.gadget: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for time, (left, right) in enumerate(merges):
            u, v, uv = vocab[left], vocab[right], vocab[left + right]
            self.gadget[u, v] = time
            self.parts.setdefault(uv, (time, u, v))
        self.arcs: dict[tuple[int, int], bool] = {}
        # Labels by symbol; "" and END have the token that a spelling is within and at the end of a word.
        self.spelled: dict = {}
        for token, i in vocab.items():
            node = self.spelled
            for symbol in token.removesuffix(END):
                node = node.setdefault(symbol, {})
            node[END if token.endswith(END) else ""] = i

    def arc(self, w: int, x: int) -> bool:
        """Whether the finished automaton has an arc ``x`` at the state after ``w``."""
        known = self.arcs.get((w, x))
        if known is None:
            if len(self.arcs) >= MAX_ARCS:
                self.arcs.clear()
            known = self.arcs[w, x] = self._undo(w, x)
        return known

    def _undo(self, w: int, x: int) -> bool:
        until = len(self.gadget)  # gadgets before this time could have taken the arc out
        while True:
            if self.gadget.get((w, x), until) < until:
                return False
            made_w, made_x = self.parts.get(w, (-1,))[0], self.parts.get(x, (-1,))[0]
            if made_w < 0 and made_x < 0:
                return True
            if made_x > made_w:
                # The gadget that made x took its own arc out before it copied what was left, unless the state
                # asked for is the one from before that gadget.
                until, x = min(until, made_x + 1), self.parts[x][1]
            else:
                until, w = made_w, self.parts[w][2]

    def steps(self, word: str, at: int) -> list[tuple[int, int]]:
        """(token, end) of the arcs that spell on from ``at``, the shortest first; the last one must end the word."""
        found, node, end = [], self.spelled, len(word)
        while at < end:
            node = node.get(word[at])
            if node is None:
                return found
            at += 1
            token = node.get("" if at < end else END)
            if token is not None:
                found.append((token, at))
        return found

    def encode(self, word: str) -> tuple[int, ...]:
        """Ids of the one path that spells ``word``; ``word`` has a symbol for each byte.

        Each prefix has one path, so a place in the word from which no arc leads on is dead however it was reached.
        """
        n, arc = len(word), self.arc
        if not n:
            return ()
        ids, ways, dead = [], [self.steps(word, 0)], set()
        while True:
            while ways[-1]:
                token, end = ways[-1].pop()
                if end not in dead and (not ids or arc(ids[-1], token)):
                    break
            else:
                ways.pop()
                ids.pop()
                continue
            ids.append(token)
            if end == n:
                return tuple(ids)
            ways.append(self.steps(word, end))
            dead.add(end)


class Known(dict):
    """Encoded words by word; emptied when full. Very long words are not kept."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.encode(word)
        if len(word) <= 40:
            if len(self) >= MAX_WORDS:
                self.clear()
            self[word] = ids
        return ids


class WordBpe:
    """Normaliser, word splitter and automaton of a tokenizer file of this kind."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        model = data["model"]
        self.automaton = MergeAutomaton(model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]])
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        pattern = next(p["pattern"]["Regex"] for p in data["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.settled = re.compile(pattern.replace(r"[\p{L}]", LETTER).replace(r"[\p{N}]", NUMBER).replace(r"[^\s\p{L}\p{N}]", OTHER))
        self.symbols = byte_symbols()
        self.label = self.automaton.label | {i: t for t, i in self.special.items()}
        self.words = Known(lambda word: self.automaton.encode("".join([self.symbols[b] for b in word.encode()])))
        self.library = Tokenizer.from_str(spec)

    def plain_ids(self, text: str) -> list[int]:
        """Ids of a text without special tokens. Lower-casing goes by code point, so a final sigma isn't special."""
        if UNSETTLED.search(text):
            words = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            return list(chain.from_iterable(self.automaton.encode(word) for word, _ in words))
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return list(chain.from_iterable(map(self.words.__getitem__, self.settled.findall(text.lower()))))

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if "<|" not in text or not self.at_special:
            return self.plain_ids(text)
        return list(chain.from_iterable([self.special[part]] if part in self.special else self.plain_ids(part) for part in self.at_special.split(text)))

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, parted by spaces: the file has no decoder."""
        return " ".join([self.label[i] for i in ids])


_loaded: dict[str, WordBpe] = {}


def tokenizer_of(broadcast) -> WordBpe:
    """The tokenizer of a broadcast file, built once in each Python worker."""
    key = hashlib.sha256(broadcast.value.encode()).hexdigest()
    if key not in _loaded:
        _loaded[key] = WordBpe(broadcast.value)
    return _loaded[key]


def spread(df: DataFrame, path: str):
    """The tokenizer file to all workers; its size is that of the vocabulary, a few MB whatever the corpus."""
    return df.sparkSession.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the identifier and the text's ids."""
    spec, schema = spread(df, path), T.StructType([field(df, id_col), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batch):
        t = tokenizer_of(spec)
        return {id_col: batch.column(0), "ids": [t.encode(x) for x in batch.column(1).to_pylist()]}

    return map_slices(df.select(id_col, text_col), run, schema)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: the identifier and the decoded text; null ids are no ids."""
    spec, schema = spread(df, path), T.StructType([field(df, id_col), T.StructField("decoded", T.StringType())])

    def run(batch):
        t = tokenizer_of(spec)
        return {id_col: batch.column(0), "decoded": [t.decode(x or []) for x in batch.column(1).to_pylist()]}

    return map_slices(df.select(id_col, ids_col), run, schema)


def token_digest(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: number of tokens, digest of the ids, digest of what they decode to."""
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    spec, schema = spread(df, path), T.StructType([field(df, id_col), *fields])

    def run(batch):
        t = tokenizer_of(spec)
        out = {id_col: batch.column(0), "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for text in batch.column(1).to_pylist():
            ids = t.encode(text)
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(t.decode(ids).encode()).hexdigest())
        return out

    return map_slices(df.select(id_col, text_col), run, schema)
