"""Token counts of a unigram tokenizer by dynamic programming over a trie of pre-tokens.

Pre-tokens (a word mark and a white-space separated word) are deduplicated; each task
inserts the distinct ones it meets in a trie that it keeps.  A node holds the forward
score of the string that leads to it, the best segmentation's sum of unigram scores and
its number of tokens, so a prefix that pre-tokens share is scored once; the number at
the end of a pre-token is its token count, and a text's count is the sum over its words.

The vocabulary is a public tokenizer's file, whose path is a parameter.  It is not
trained here and holds no unigram probabilities: a piece's score is its Zipf log
probability by rank, -log(rank) - log(harmonic sum).  Characters that no piece covers
cost one token a UTF-8 byte.  Ties between segmentations go to fewer tokens.

Counting needs no shuffle.  A trie of more than ``NODES`` nodes is begun anew, and of a
pre-token of more than ``DEPTH`` letters the rest is scored without nodes: both bound its
memory and change no count.

Defined results: null and empty texts have no tokens; repeated rows, repeated ids and
null ids are rows of their own; a word of any length is walked without recursion; an
empty table gives an empty result; extra columns are ignored; a missing vocabulary file
is an error that names it.
"""

from __future__ import annotations

import math
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, flat, words

MARK = "▁"
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Log probability of one byte of an uncovered character; nodes of a trie; letters of a pre-token that are kept in it;
#: pre-tokens whose counts a task remembers.
BYTE_SCORE, NODES, DEPTH, KNOWN = -20.0, 1_000_000, 256, 500_000


def pieces(path: str = VOCABULARY) -> dict[str, float]:
    """Scores of the vocabulary's pieces (special and byte pieces excluded)."""
    import sentencepiece

    if not os.path.exists(path):
        raise FileNotFoundError(f"no vocabulary at {path}: pass the path of a sentencepiece model that driver and executors have")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    total = math.log(sum(1 / (r + 1) for r in range(model.get_piece_size())))
    return {
        model.id_to_piece(i): -math.log(i + 1) - total
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    }


class Trie:
    """Pre-tokens as paths of characters.  A node holds the best (score, -tokens) of the string that leads to it."""

    def __init__(self, scores: dict[str, float]):
        self.scores, self.longest = scores, max(map(len, scores), default=1)
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.best: list[tuple[float, int]] = [(0.0, 0)]

    def count(self, token: str) -> int:
        """Tokens of a pre-token: its path is walked as far as the trie has it, and the rest is scored and inserted."""
        child, best, node, path = self.child, self.best, 0, [0]
        for end, letter in enumerate(token[:DEPTH], 1):
            below = child.get((node, letter))
            if below is None:
                below = child[node, letter] = len(best)
                best.append(self.forward(token, end, path))
            node = below
            path.append(node)
        return -(best[node] if len(token) <= DEPTH else self.beyond(token, path))[1]

    def beyond(self, token: str, path: list[int]) -> tuple[float, int]:
        """The best segmentation of a pre-token longer than DEPTH, whose prefix is in the trie: of the rest, which nobody shares,
        only the scores that the longest piece can reach back to are held."""
        get, recent = self.scores.get, [self.best[node] for node in path[-self.longest :]]
        for end in range(DEPTH + 1, len(token) + 1):
            size = len(token[end - 1].encode())
            score, count = recent[-1]
            found = (score + BYTE_SCORE * size, count - size)
            for back in range(1, len(recent) + 1):
                s = get(token[end - back : end])
                if s is not None:
                    score, count = recent[-back]
                    if (score + s, count - 1) > found:
                        found = (score + s, count - 1)
            recent.append(found)
            del recent[: -self.longest]
        return recent[-1]

    def forward(self, token: str, end: int, path: list[int]) -> tuple[float, int]:
        """The best segmentation of token[:end] from those of its prefixes, whose nodes are the path."""
        get, best, size = self.scores.get, self.best, len(token[end - 1].encode())
        score, count = best[path[end - 1]]
        found = (score + BYTE_SCORE * size, count - size)
        for begin in range(max(0, end - self.longest), end):
            s = get(token[begin:end])
            if s is not None:
                score, count = best[path[begin]]
                if (score + s, count - 1) > found:
                    found = (score + s, count - 1)
        return found

    def counts(self, tokens: list[str]) -> list[int]:
        out = []
        for token in tokens:
            if len(self.best) > NODES:
                self.clear()
            out.append(self.count(token))
        return out


def distinct_words(data: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct words at [begin, stop), told apart by their bytes, and for each word which one it is."""
    if not len(begin):
        return [], np.zeros(0, np.int64)
    # Words and what is between them tile the data from the first word on: every other tile is a word.
    tiles = np.stack([begin, stop], 1).ravel()
    coded = pa.Array.from_buffers(pa.large_binary(), len(tiles) - 1, [None, pa.py_buffer(tiles.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    used, slot = np.unique(coded.indices.to_numpy()[::2], return_inverse=True)
    return coded.dictionary.take(pa.array(used)).to_pylist(), slot


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_words and n_tokens of each row of docs (doc_id, text)."""
    scores = pieces(vocabulary)

    def count(batches):
        trie, known = Trie(scores), {}
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            n_words, n_tokens = [], []
            for i, j in chunks(offsets):
                part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                begin, stop, index = words(part, own)
                distinct, slot = distinct_words(part, begin, stop)
                if len(known) > KNOWN:
                    known.clear()
                fresh = [w for w in distinct if w not in known]
                known.update(zip(fresh, trie.counts([MARK + w.decode(errors="replace") for w in fresh]), strict=True))
                each = np.array([known[w] for w in distinct], np.int64)[slot]
                total = np.concatenate([[0], np.cumsum(each)])
                n_words.append(np.diff(index))
                n_tokens.append(total[index[1:]] - total[index[:-1]])
            cat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), cat(n_words), cat(n_tokens)], ["doc_id", "n_words", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id bigint, n_words bigint, n_tokens bigint")
