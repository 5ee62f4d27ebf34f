"""Token counts by the whole-token shortcut: vocabulary strings proven to encode alone as one token are counted directly.

The proof runs once, on the vocabulary alone (`prove`):

* A merge only ever makes a string of the vocabulary.  Characters that no longer string holds therefore never merge, and where no
  string has a space mark behind another character, nothing merges across that place.  Cutting a text there into
  pre-tokens leaves its encoding as it is: the pre-tokens' tokens add up.
* Each vocabulary string that can be a pre-token is encoded alone.  Those that come out as their own single token are whole tokens;
  a string that merging does not reach is not.

A text is then cut into pre-tokens; whole tokens count one each, and only the rest is merged by the library, every distinct
one once in a task as long as it is held.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

from gridreach.llm.text import keyed, over_batches

MARK = "▁"
#: Characters of a text cut at a time; pre-tokens counted at a time; merged ones remembered by a task, and the longest of them.
PIECE, LOT, HELD, LONG = 1 << 20, 1 << 18, 1 << 19, 64


@dataclass(frozen=True)
class Proof:
    """What the vocabulary alone settles: the pre-token pattern, the whole tokens and the model without the leading mark."""

    pattern: str
    whole: frozenset[str]
    model: bytes


def prove(path: str) -> Proof:
    """Read a sentencepiece BPE model and prove its whole tokens; ValueError for a model whose normaliser changes texts."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.ParseFromString(Path(path).read_bytes())
    norm, kind = model.normalizer_spec, model.trainer_spec
    kinds = pb.ModelProto.SentencePiece
    if kind.model_type != pb.TrainerSpec.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces or kind.treat_whitespace_as_suffix:
        raise ValueError(f"{path}: only BPE models that keep every character of a text are supported")
    if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
        raise ValueError(f"{path}: user-defined and unused pieces are cut before merging")
    strings = [p.piece for p in model.pieces if p.type == kinds.NORMAL]
    merging = {c for s in strings if len(s) > 1 for c in s}
    inside = "[" + "".join(re.escape(c) for c in sorted(merging - {MARK})) + "]"
    if any(MARK in s.lstrip(MARK) for s in strings):  # marks merge with what stands before them
        pattern = f"(?:{inside}|{MARK})+|(?s:.)"
    else:
        pattern = f"{MARK}*{inside}+|{MARK}+|(?s:.)"
    norm.add_dummy_prefix = False
    alone = model.SerializeToString()
    encoder = sentencepiece.SentencePieceProcessor(model_proto=alone)
    whole = re.compile(pattern)
    able = [s for s in strings if whole.fullmatch(s)]
    proven = frozenset(s for s, ids in zip(able, encoder.encode(able, num_threads=1), strict=True) if len(ids) == 1 and encoder.id_to_piece(ids[0]) == s)
    return Proof(pattern, proven, alone)


class Costs:
    """Tokens of pre-tokens: one for each whole token; others are merged when first met and held up to a bound."""

    def __init__(self, proof: Proof) -> None:
        import sentencepiece

        self.whole = dict.fromkeys(proof.whole, 1)
        self.known = dict(self.whole)
        self.encoder = sentencepiece.SentencePieceProcessor(model_proto=proof.model)
        self.merged = 0

    def sums(self, lists: list[list[str]]) -> list[int]:
        """Tokens of each list; what is not known yet is merged in one call."""
        rest = list(set().union(*lists).difference(self.known))
        if len(self.known) + len(rest) > len(self.whole) + HELD:
            self.known = dict(self.whole)
            rest = list(set().union(*lists).difference(self.known))
        self.known.update(zip(rest, map(len, self.encoder.encode(rest, num_threads=1)), strict=True))
        self.merged += len(rest)
        out = [sum(map(self.known.__getitem__, pre)) for pre in lists]
        for pre in rest:
            if len(pre) > LONG:
                del self.known[pre]
        return out


def pre_tokens(text: str, pattern: re.Pattern[str]) -> Iterator[list[str]]:
    """The pre-tokens of a text, leading mark included, about PIECE characters at a time; nothing of an empty one."""
    marked = MARK + text.replace(" ", MARK) if text else ""
    at = 0
    size = PIECE
    while at < len(marked):
        found = pattern.findall(marked, at, at + size)
        end = at + size
        if end < len(marked):  # the last pre-token may go on behind the end
            last = found.pop()
            end -= len(last)
        if end > at:
            yield found
            at, size = end, PIECE
        else:
            size *= 2  # one pre-token longer than the piece


def count(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document under the model at `path`.

    Counts are the library's own: no begin, end or added special token, special strings inside a text taken as its default does,
    nothing truncated or padded.  A null text counts as empty: no byte, no token.  A null id is carried along, repeated rows give repeated
    results, extra columns are ignored, an empty table gives an empty result.  The driver reads the model once; its size, not the
    table's, bounds what tasks get.
    """
    proof = prove(path)
    ready: list[tuple[Costs, re.Pattern[str]]] = []

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not ready:
            ready.append((Costs(proof), re.compile(proof.pattern)))
        costs, pattern = ready[0]
        size, tokens, rows, lists, held = [], [0] * batch.num_rows, [], [], 0

        def settle() -> None:
            for row, n in zip(rows, costs.sums(lists), strict=True):
                tokens[row] += n
            rows.clear()
            lists.clear()

        texts = batch.column("text")
        for i in range(0, len(texts), 64):
            for row, text in enumerate(texts.slice(i, 64).to_pylist(), i):
                size.append(len(text.encode()) if text else 0)
                for found in pre_tokens(text or "", pattern):
                    rows.append(row)
                    lists.append(found)
                    held += len(found)
                    if held >= LOT:
                        settle()
                        held = 0
        settle()
        columns = [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return over_batches(keyed(docs, "doc_id", "text"), one, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
