"""SentencePiece BPE encoding by a table of each prefix's last token, and decoding."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

MARK = "▁"
_LOWEST = float("-inf")


class PieceBPE:
    """Encoder and decoder for a BPE model with byte fallback, the identity normaliser and a dummy prefix.

    For a text x let last(i) be the last token of the encoding of its prefix of i characters. BPE encodings are
    compatible with prefixes: a token b that ends at i is last(i) exactly if the prefix before b is empty, or its own last
    token a makes a compatible pair with b, that is, BPE encodes the text of a and b as a, b. So one pass over the matches of an
    Aho-Corasick automaton fills the table from left to right, and the ids follow backwards from its end.

    No piece holds MARK behind another character, so texts are cut before each MARK that follows another character
    (and around characters that occur in no longer piece); parts are encoded once and kept, up to ``limit`` of them.
    """

    def __init__(self, model: bytes, limit: int = 500_000):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with byte fallback, a dummy prefix and no normalisation are supported")
        self.pieces, self.scores, self.bytes = {}, {}, {}
        self.text: list[bytes] = []
        for i, p in enumerate(proto.pieces):
            if p.type == p.BYTE:
                self.bytes[int(p.piece[1:-1], 16)] = i
                self.text.append(bytes([int(p.piece[1:-1], 16)]))
            elif p.type == p.NORMAL:
                if MARK in p.piece.lstrip(MARK) or p.piece[0] == p.piece[1:2] == MARK and p.piece.strip(MARK):
                    raise ValueError(f"piece {p.piece!r} spans words")
                self.pieces[p.piece], self.scores[p.piece] = i, p.score
                self.text.append(p.piece.replace(MARK, " ").encode())
            elif p.type in (p.USER_DEFINED, p.UNUSED):
                raise ValueError("user-defined and unused pieces are not supported")
            else:
                self.text.append(b"")
        self.byte_ids = frozenset(self.bytes.values())
        self.automaton = ahocorasick.Automaton()
        for p in self.pieces:
            self.automaton.add_word(p, (p, len(p)))
        self.automaton.make_automaton()
        inside = {c for p in self.pieces if len(p) > 1 for c in p}
        alone = "".join(re.escape(c) for c in "\n\t\r" if c not in inside)
        self.parts = re.compile(f"[{alone}]|{MARK}*[^{MARK}{alone}]+|{MARK}+").findall
        self.pairs: dict[str, dict[str, bool]] = {"": {}}
        self.pair_count, self.pair_limit = 0, limit
        self.traces: dict[str, tuple[list[float], list[str], list[str]] | None] = {}
        self.known = _Parts(self, limit)

    def trace(self, piece: str) -> tuple[list[float], list[str], list[str]] | None:
        """How BPE builds a piece: the score of each merge (the best, the leftmost of equals), and the first and last token before it.

        The last entries are minus infinity and the piece. None if BPE of its text gives other tokens.
        """
        if piece not in self.traces:
            tokens, scores, firsts, lasts = list(piece), [], [], []
            while True:
                firsts.append(tokens[0])
                lasts.append(tokens[-1])
                best = max(((self.scores[a + b], -i) for i, (a, b) in enumerate(zip(tokens, tokens[1:])) if a + b in self.scores), default=None)
                if best is None:
                    break
                scores.append(best[0])
                tokens[-best[1] : 2 - best[1]] = [tokens[-best[1]] + tokens[1 - best[1]]]
            self.traces[piece] = ([*scores, _LOWEST], firsts, lasts) if len(tokens) == 1 else None
        return self.traces[piece]

    def compatible(self, a: str, b: str) -> bool:
        """Whether BPE encodes the text of a and b as a, b; with an empty a, whether it encodes b as b. Kept for later calls.

        The merges inside a and inside b are interleaved by score; the pair is compatible unless a merge across the border comes first at some time.
        """
        if self.pair_count >= self.pair_limit:
            self.pairs, self.pair_count = {"": {}}, 0
        self.pair_count += 1
        own = self.pairs.setdefault(a, {})
        right = self.trace(b)
        if not a or right is None:
            own[b] = right is not None
            return own[b]
        (sa, _, lasts), (sb, firsts, _) = self.trace(a), right
        i = j = 0
        while True:
            across = self.scores.get(lasts[i] + firsts[j])
            if across is not None and across > sa[i] and across >= sb[j]:
                own[b] = False
                return False
            if sa[i] >= sb[j]:
                if sa[i] == _LOWEST:
                    own[b] = True
                    return True
                i += 1
            else:
                j += 1

    def part(self, text: str) -> array:
        """The ids of a part: fill the table of last tokens, then read it backwards."""
        pieces, pairs = self.pieces, self.pairs
        last: list[str] = [""] * (len(text) + 1)
        known = all(map(pieces.__contains__, text))
        done = 0  # ends filled so far, but for characters that are no piece
        for end, (piece, size) in self.automaton.iter(text):
            end += 1
            if last[end]:
                continue
            start = end - size
            if not known:
                for i in range(done, end - 1):  # a character in no matching piece stands alone
                    last[i + 1] = last[i + 1] or text[i]
                done = end - 1
            before = last[start]
            ok = pairs.get(before, _NONE).get(piece)
            if ok is None:
                ok = self.compatible(before, piece)
                pairs = self.pairs
            if ok:
                last[end] = piece
        out, at = [], len(text)
        while at:
            piece = last[at] or text[at - 1]
            if piece in pieces:
                out.append(pieces[piece])
            else:
                out += [self.bytes[b] for b in reversed(piece.encode())]
            at -= len(piece)
        out.reverse()
        return array("i", out)

    def encode(self, text: str) -> np.ndarray:
        """Ids, as int32."""
        if not text:
            return np.empty(0, np.int32)
        return np.frombuffer(b"".join(map(self.known.__getitem__, self.parts(MARK + text.replace(" ", MARK)))), np.int32)

    def decode(self, ids) -> str:
        text = self.text
        ids = list(ids)
        out = b"".join(map(text.__getitem__, ids))
        if out[:1] == b" " and ids[0] not in self.byte_ids:
            out = out[1:]
        return out.decode("utf-8", "replace")


_NONE: dict[str, bool] = {}


class _Parts(dict):
    """part -> the bytes of its ids, filled as parts appear; long parts aren't kept, and at ``limit`` parts it starts anew."""

    def __init__(self, coder: PieceBPE, limit: int):
        super().__init__()
        self.coder, self.limit = coder, limit

    def __missing__(self, part: str) -> bytes:
        ids = self.coder.part(part).tobytes()
        if len(part) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[part] = ids
        return ids


_coders: dict[int, PieceBPE] = {}


def coder_for(model: bytes) -> PieceBPE:
    """One coder per worker and model, so that what it has learned of parts and pairs is kept between tasks."""
    key = hash(model)
    if key not in _coders:
        _coders.clear()
        _coders[key] = PieceBPE(model)
    return _coders[key]


def _slices(column: pa.ChunkedArray | pa.Array, limit: int = 4 << 20) -> Iterator[tuple[int, list]]:
    """(first row, values) in slices of about ``limit`` characters, so that one batch of long texts isn't held as lists at once."""
    start, held, size = 0, [], 0
    for i, x in enumerate(column):
        held.append(x.as_py())
        size += len(held[-1] or "")
        if size >= limit:
            yield start, held
            start, held, size = i + 1, [], 0
    if held:
        yield start, held


def tokenize(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, ids`` (array of int), ``decoded``: exactly the library's encode() without extra ids, and decode().

    The model file is read on the driver (``model_path``, half a megabyte) and travels with the task. Null texts count as empty;
    empty texts have no ids and decode to the empty text. Rows that repeat are encoded each; an empty table gives no rows. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    with open(model_path, "rb") as f:
        model = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_for(model)
        for batch in batches:
            for start, texts in _slices(batch.column(1)):
                found = [coder.encode(text or "") for text in texts]
                decoded = [coder.decode(ids.tolist()) for ids in found]
                ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), ids, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text").mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")
