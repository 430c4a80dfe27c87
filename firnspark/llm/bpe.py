"""BPE by a deterministic automaton: merges are compiled gadget by gadget, words are read by table.

The automaton reads symbols (bytes, the last of a word in its word-end form). Its arcs over whole
tokens are built merge by merge: the gadget of a merge (u, v) adds an arc labelled uv, hangs it
under the left spine of u and the right spine of v, and forbids the arc v after u. Which token may
follow which is then decided by the spines alone. Determinised, a state is the set of tokens still
being read, each with the token before it; transitions are computed once and then looked up.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from firnspark.llm.common import trimmed

#: The pattern that splits normalized text, and Unicode white space: fixed values.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"
NEVER = 1 << 60


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = (b for b in range(256) if b not in shown)
    moved = {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [moved.get(b) or chr(b) for b in range(256)]


class Automaton:
    """Compiled merges with lazily filled transition tables.

    max_states and max_words bound the tables; beyond them they start anew, results stay the same.
    """

    def __init__(self, spec: dict, max_states: int = 150_000, max_words: int = 400_000):
        vocab: dict[str, int] = spec["model"]["vocab"]
        end: str = spec["model"]["end_of_word_suffix"] or ""
        self.label = {i: s for s, i in vocab.items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.label.update({i: s for s, i in self.special.items()})
        letters = byte_letters()
        # Symbols: b for a byte within a word, 256 + b for a word's last byte.
        self.base = [vocab[c] for c in letters] + [vocab[c + end] for c in letters]
        self.length: dict[int, int] = {}
        self.left: dict[int, tuple] = {}
        self.right: dict[int, tuple] = {}
        self.merge_rank: dict[tuple[int, int], int] = {}
        self.trie: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        self.allowed: dict[tuple[int, int], bool] = {}
        spelled: dict[int, tuple[int, ...]] = {}
        for symbol, token in enumerate(self.base):
            spelled[token] = (symbol,)
            self.left[token] = self.right[token] = ((token, NEVER),)
            self._add_arc(token, spelled[token])
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self._add_gadget(vocab[a], vocab[b], vocab[a + b], rank, spelled)
        self.max_states, self.max_words = max_states, max_words
        self._reset()
        self.words: dict[str, tuple[str, str]] = {}

    def _add_arc(self, token: int, symbols: tuple[int, ...]) -> None:
        self.length[token] = len(symbols)
        node = 0
        for s in symbols:
            nxt = self.trie[node].get(s)
            if nxt is None:
                nxt = len(self.trie)
                self.trie.append({})
                self.token_at.append(-1)
                self.trie[node][s] = nxt
            node = nxt
        self.token_at[node] = token

    def _add_gadget(self, u: int, v: int, uv: int, rank: int, spelled: dict) -> None:
        self.merge_rank[u, v] = rank
        spelled[uv] = spelled[u] + spelled[v]
        # A spine lists the parts at an end of the token, with the rank of the merge that takes each away.
        self.left[uv] = (*((t, min(gone, rank)) if t == u else (t, gone) for t, gone in self.left[u]), (uv, NEVER))
        self.right[uv] = (*((t, min(gone, rank)) if t == v else (t, gone) for t, gone in self.right[v]), (uv, NEVER))
        # The token is read as itself only if no earlier gadget cuts across its seam.
        if self._may_follow(u, v, below=rank):
            self._add_arc(uv, spelled[uv])

    def _may_follow(self, u: int, v: int, below: int = NEVER) -> bool:
        """Whether no merge ranked before `below` joins an end part of u with a first part of v.

        At one rank the leftmost merge comes first: within u it precedes the seam, within v it follows it.
        """
        for a, gone_a in self.right[u]:
            for b, gone_b in self.left[v]:
                rank = self.merge_rank.get((a, b))
                if rank is not None and rank < below and rank < gone_a and rank <= gone_b:
                    return False
        return True

    def _reset(self) -> None:
        self.state_of: dict[tuple, int] = {}
        self.configs: list[tuple] = []
        self.done: list[int] = []
        self.step: list[dict[int, int]] = []
        self._state((), -2)

    def _state(self, configs: tuple, done: int) -> int:
        key = (configs, done)
        found = self.state_of.get(key)
        if found is None:
            found = self.state_of[key] = len(self.configs)
            self.configs.append(configs)
            self.done.append(done)
            self.step.append({})
        return found

    def _next(self, state: int, symbol: int) -> int:
        """The transition: every open reading goes on, and one starts after the token that just ended."""
        kept, done = [], -1
        for before, node in (*self.configs[state], (self.done[state], 0)):
            if before == -1 or (node := self.trie[node].get(symbol)) is None:
                continue
            token = self.token_at[node]
            if token >= 0 and done == -1:
                ok = before == -2 or self.allowed.get((before, token))
                if ok is None:
                    ok = self.allowed[before, token] = self._may_follow(before, token)
                if ok:
                    done = token
            if self.trie[node]:
                kept.append((before, node))
        return self._state(tuple(kept), done)

    def read(self, symbols: list[int]) -> list[int]:
        """Token ids of one pre-split word."""
        if len(self.configs) > self.max_states:
            self._reset()
        if len(self.allowed) > 8 * self.max_states:
            self.allowed.clear()
        path, state = [], 0
        for s in symbols:
            nxt = self.step[state].get(s)
            if nxt is None:
                nxt = self.step[state][s] = self._next(state, s)
            path.append(state := nxt)
        out, at = [], len(path)
        while at:
            token = self.done[path[at - 1]]
            out.append(token)
            at -= self.length[token]
        return out[::-1]

    def ids_of(self, chunk: str) -> list[int]:
        """Ids of a run of text without white space and special tokens."""
        out: list[int] = []
        for piece in _pieces().findall(normalized(chunk)):
            symbols = list(piece.encode())
            symbols[-1] += 256
            out += self.read(symbols)
        return out

    def word(self, chunk: str) -> tuple[str, str]:
        """Ids and labels of a run of text without white space, both joined by a space."""
        ids = self.ids_of(chunk)
        found = (" ".join(map(str, ids)), self.emit(ids))
        if len(chunk) <= 64:
            if len(self.words) >= self.max_words:
                self.words.clear()
            self.words[chunk] = found
        return found

    def emit(self, ids: list[int]) -> str:
        """Decode: the labels of the arcs, joined by a space."""
        return " ".join([self.label[i] for i in ids])

    def _between(self, text: str) -> list[str]:
        """Special tokens, as they stand in the raw text, and what is between them."""
        if not any(s in text for s in self.special):
            return [text]
        return regex.split("(" + "|".join(map(regex.escape, self.special)) + ")", text)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self._between(text):
            if part in self.special:
                out.append(self.special[part])
            else:
                for chunk in chunks(part):
                    out += self.ids_of(chunk)
        return out

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, ids joined by a space, decoded text."""
        found: list[tuple[str, str]] = []
        held = self.words
        for part in self._between(text):
            if part in self.special:
                found.append((str(self.special[part]), part))
                continue
            own = chunks(part)
            got = list(map(held.get, own))
            if None in got:
                got = [x or self.word(c) for x, c in zip(got, own, strict=True)]
            found += got
        ids = " ".join([x[0] for x in found if x[0]])
        return ids.count(" ") + 1 if ids else 0, ids, " ".join([x[1] for x in found if x[0]])


def chunks(text: str) -> list[str]:
    """Runs of anything but white space. Python's own split also cuts at four control characters, which aren't."""
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return [x for x in text.translate(_SPACES).split(" ") if x]
    return text.split()


_SPACES = {ord(c): " " for c in SPACE}
_PATTERN: list = []


def _pieces():
    if not _PATTERN:
        _PATTERN.append(regex.compile(PIECES))
    return _PATTERN[0]


def normalized(text: str) -> str:
    """NFC, then each character's own lower case (no rule for a final sigma)."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


_LOADED: dict[str, Automaton] = {}


def automaton(spec: str) -> Automaton:
    """The automaton of a vocabulary (its JSON text), compiled once in each Python process."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Automaton(json.loads(spec))
    return _LOADED[key]


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<int>) and decoded of every whole text.

    vocabulary: path of the tokenizer's JSON on the driver, at most some MB, sent with the tasks.
    Null and empty texts have no ids and an empty decoded text. Repeated rows stay, other columns
    are dropped, an empty table gives an empty one. No shuffle.
    """
    held = docs.sparkSession.sparkContext.broadcast(open(vocabulary, encoding="utf-8").read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = automaton(held.value)
        for batch in batches:
            ids = [own.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([own.emit(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.selectExpr(f"CAST(`{id_col}` AS LONG) AS doc_id", f"`{text_col}` AS text").mapInArrow(trimmed(run), "doc_id long, ids array<int>, decoded string")


def decode_ids(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and decoded: the labels of the ids, joined by a space; null ids decode to an empty text."""
    held = encoded.sparkSession.sparkContext.broadcast(open(vocabulary, encoding="utf-8").read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = automaton(held.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.emit(x or []) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "decoded"])

    return encoded.selectExpr(f"CAST(`{id_col}` AS LONG) AS doc_id", f"`{ids_col}` AS ids").mapInArrow(trimmed(run), "doc_id long, decoded string")


def token_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text; cases as in encode_documents.

    Frequent words are looked up whole, so ids and labels are joined without leaving text form.
    """
    held = docs.sparkSession.sparkContext.broadcast(open(vocabulary, encoding="utf-8").read())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = automaton(held.value)
        for batch in batches:
            n, ids, decoded = [], [], []
            for text in batch.column(1):
                a, b, c = own.digest(text.as_py() or "")
                n.append(a)
                ids.append(sha(b))
                decoded.append(sha(c))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr(f"CAST(`{id_col}` AS LONG) AS doc_id", f"`{text_col}` AS text").mapInArrow(trimmed(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
