"""Token counts by a linear longest-match automaton.

A word is the UTF-8 bytes of a lower-cased piece of text followed by an end mark. The vocabulary (the word-end BPE file)
gives the pieces: a piece that closes a word carries the mark. Greedy longest match from the left then always succeeds,
because every byte is a piece; where the last piece
doesn't close the word, the mark that is left counts nothing. The automaton is the vocabulary's trie with, for each node, a
failure link and the number of pieces that leave the match when the link is taken. One pass over the bytes gives the
number of pieces; no piece is ever built.

Nulls and empty texts count 0 words and 0 tokens. Repeated rows are counted row by row. Texts are read whole.
"""

from __future__ import annotations

import json
from collections import deque
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from photonlake.llm.common import arrow_map, id_text, texts, vocabulary_path

#: The word pattern of the vocabulary: contractions, letters, one digit, other symbols.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
END = 256
CACHE_WORDS = 400_000


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use, back to bytes: printable Latin-1 characters stand for
    themselves, the other bytes follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class LongestMatch:
    """Counts the greedy longest-match pieces of a word in time linear in its length."""

    def __init__(self, pieces: list[tuple[int, ...]]):
        pieces = [*pieces, (END,)]
        children: list[dict[int, int]] = [{}]
        whole = [False]
        for piece in pieces:
            node = 0
            for symbol in piece:
                nxt = children[node].get(symbol)
                if nxt is None:
                    nxt = children[node][symbol] = len(children)
                    children.append({})
                    whole.append(False)
                node = nxt
            whole[node] = True
        n = len(children)
        self.children, self.link, self.popped = children, [-1] * n, [0] * n
        queue = deque([0])
        while queue:
            at = queue.popleft()
            for symbol, node in children[at].items():
                queue.append(node)
                if whole[node]:
                    self.link[node], self.popped[node] = 0, int((at, symbol) != (0, END))
                    continue
                back, count = self.link[at], self.popped[at]
                while back >= 0 and symbol not in children[back]:
                    count += self.popped[back]
                    back = self.link[back]
                if back >= 0:
                    self.link[node], self.popped[node] = children[back][symbol], count

    def count(self, word: bytes, end: int | None = END) -> int:
        children, link, popped = self.children, self.link, self.popped
        node = found = 0
        for symbol in (*word, end) if end is not None else word:
            while (nxt := children[node].get(symbol)) is None:
                found += popped[node]
                node = link[node]
                if node < 0:
                    raise ValueError("the vocabulary lacks a single-symbol piece")
            node = nxt
        while node:
            found += popped[node]
            node = link[node]
        return found


@lru_cache(maxsize=2)
def automaton(path: str) -> LongestMatch:
    back = byte_symbols()
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    pieces = []
    for piece in vocab:
        closing = piece.endswith("</w>")
        body = piece[:-4] if closing else piece
        if body and all(c in back for c in body):
            pieces.append(tuple(back[c] for c in body) + ((END,) if closing else ()))
    return LongestMatch(pieces)


@lru_cache(maxsize=2)
def _seen(path: str) -> dict[str, tuple[int, int]]:
    return {}


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_chars, n_words and n_tokens of every document. No shuffle: one pass over the rows.

    `path` names a vocabulary file that every executor can read."""
    path = path or vocabulary_path("word_bpe_49k.json")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        machine, seen = automaton(path), _seen(path)
        chars, words, tokens = [], [], []
        for text in texts(batch):
            text = text or ""
            total = n_words = 0
            for run in text.split():
                n = seen.get(run)
                if n is None:
                    if len(seen) >= CACHE_WORDS:
                        seen.clear()
                    found = WORDS.findall(run.lower())
                    n = seen[run] = (len(found), sum(machine.count(w.encode("utf-8", "replace")) for w in found))
                n_words += n[0]
                total += n[1]
            chars.append(len(text))
            words.append(n_words)
            tokens.append(total)
        return pa.record_batch([batch.column("doc_id"), pa.array(chars, pa.int64()), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_chars", "n_words", "n_tokens"])

    return arrow_map(id_text(docs), count, "doc_id long, n_chars long, n_words long, n_tokens long")
