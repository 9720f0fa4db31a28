"""Chat formatting by assembling tokens: segments are encoded apart, reserved ids are spliced between them, loss masks are
prefix sums over segment bounds, and control strings inside texts are escaped reversibly.

Template of a turn: <|im_start|> role <|im_sep|> text <|im_end|>. The three marks are reserved ids after the
vocabulary's own, which no text encodes to. So that the written form can be read back too, "<|" in roles and texts gets a
backslash between its characters, and one more where there are some already. The loss covers the texts of
LOSS_ROLES, without marks.

Turns are ordered by (conv_id, turn, role, text), nulls first; null roles and texts are empty; a null conv_id is one
conversation. Each turn is encoded where it is read; then the turns of a conversation stream through one task in order,
one at a time, so a conversation of any length takes bounded memory. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The marks' written form, in the order of their ids.
MARKS = ("<|im_start|>", "<|im_sep|>", "<|im_end|>")
LOSS_ROLES = ("assistant",)
BATCH_CHARS = 2_000_000
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """The text without control strings: every "<|" gets one more backslash."""
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    """What escape() was given."""
    return _UNESCAPE.sub(r"<\1|", text)


class Template:
    """A tokenizer and the reserved ids of the marks."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.start, self.sep, self.end = (self.tokenizer.get_vocab_size(with_added_tokens=True) + i for i in range(3))

    def encode(self, roles: list[str], texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all turns one after another, their loss mask, number of ids of each turn).

        Roles and texts are encoded apart; where each segment and mark goes, and which ids the mask covers, are
        prefix sums of segment sizes.
        """
        n = len(texts)
        segments = [escape(x) for pair in zip(roles, texts, strict=True) for x in pair]
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(segments, add_special_tokens=False)]
        size = np.fromiter(map(len, encoded), np.int64, 2 * n).reshape(n, 2)
        total = size.sum(axis=1) + 3
        begin = np.cumsum(total) - total
        ids = np.empty(int(total.sum()), np.int32)
        sep, end = begin + 1 + size[:, 0], begin + total - 1
        ids[begin], ids[sep], ids[end] = self.start, self.sep, self.end
        free = np.ones(len(ids), bool)
        free[np.concatenate([begin, sep, end])] = False
        ids[free] = np.concatenate([np.array(e, np.int32) for e in encoded]) if encoded else []
        loss = np.array([r in LOSS_ROLES for r in roles], np.int64)
        step = np.zeros(len(ids) + 1, np.int64)
        np.add.at(step, sep + 1, loss)
        np.add.at(step, end, -loss)
        return ids, np.cumsum(step)[:-1].astype(np.int8), total

    def text_of(self, lists: list[np.ndarray]) -> list[str]:
        """Texts of segments without marks, still escaped."""
        return self.tokenizer.decode_batch([x.tolist() for x in lists], skip_special_tokens=False)


@cache
def template(path: str) -> Template:
    """One per worker."""
    return Template(path)


_TURN = "conv_id long, turn long, role string, text string, ids array<int>, loss array<byte>"
_PLACED = "conv_id long, position long, token_start long, ids array<int>, loss array<byte>"


def _lists(flat: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat, kind))


def format_chat(turns: DataFrame, path: str) -> DataFrame:
    """(conv_id, position, token_start, ids, loss): the ids and loss mask of each turn, and where in its conversation's
    ids they begin. Rows of a conversation are in one partition, in order."""

    def encode(batches):
        made = template(path)
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            roles = [x or "" for x in batch.column("role").to_pylist()]
            begin = 0
            while begin < len(texts):
                stop, total = begin, 0
                while stop < len(texts) and (stop == begin or total + len(texts[stop]) < BATCH_CHARS):
                    total += len(texts[stop])
                    stop += 1
                ids, loss, sizes = made.encode(roles[begin:stop], texts[begin:stop])
                rows = batch.slice(begin, stop - begin)
                yield pa.RecordBatch.from_arrays([*rows.columns, _lists(ids, sizes, pa.int32()), _lists(loss, sizes, pa.int8())], names=[*batch.schema.names, "ids", "loss"])
                begin = stop

    plain = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    ordered = plain.mapInArrow(encode, _TURN).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "ids", "loss")

    def place(batches):
        now, position, at = None, 0, 0
        first = True
        for batch in batches:
            convs = batch.column("conv_id").to_pylist()
            sizes = np.diff(batch.column("ids").offsets.to_numpy())
            positions, starts = [], []
            for conv, size in zip(convs, sizes.tolist(), strict=True):
                if first or conv != now:
                    now, position, at, first = conv, 0, 0, False
                positions.append(position)
                starts.append(at)
                position, at = position + 1, at + size
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(positions, pa.int64()), pa.array(starts, pa.int64()), batch.column("ids"), batch.column("loss")],
                names=["conv_id", "position", "token_start", "ids", "loss"],
            )

    return ordered.mapInArrow(place, _PLACED)


class _Reader:
    """What is read back of one conversation, a turn at a time."""

    def __init__(self):
        self.turns = self.loss_chars = self.chars = self.tokens = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, role: str, text: str, covered: str, size: int) -> None:
        self.turns += 1
        self.tokens += size
        self.chars += len(MARKS[0]) + len(role) + len(MARKS[1]) + len(text) + len(MARKS[2])
        self.all.update(f"{unescape(role)}\n{unescape(text)}\n".encode())
        covered = unescape(covered)
        self.loss_chars += len(covered)
        self.loss.update(covered.encode())

    def row(self, conv) -> tuple:
        return conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.tokens


_READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long"


def read_back(formatted: DataFrame, path: str) -> DataFrame:
    """Counts and digests of each conversation, from the ids and masks that format_chat() gives, in its order."""

    def run(batches):
        made = template(path)
        now, reader = None, None
        names = [x.split(" ")[0] for x in _READ.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        done: list[tuple] = []

        def out():
            columns = [pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            convs = batch.column("conv_id").to_pylist()
            lists, masks = batch.column("ids"), batch.column("loss")
            ids, loss, bounds = lists.values.to_numpy(), masks.values.to_numpy(), lists.offsets.to_numpy()
            pieces = []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                own, covered = ids[a:b], loss[a:b]
                sep = int(np.flatnonzero(own == made.sep)[0])
                pieces += [own[1:sep], own[sep + 1 : -1], own[covered == 1]]
            said = made.text_of(pieces)
            for i, conv in enumerate(convs):
                if reader is None or conv != now:
                    if reader:
                        done.append(reader.row(now))
                    now, reader = conv, _Reader()
                reader.add(*said[3 * i : 3 * i + 3], int(bounds[i + 1] - bounds[i]))
            if len(done) > 10_000:
                yield out()
        if reader:
            done.append(reader.row(now))
        if done:
            yield out()

    return formatted.mapInArrow(run, _READ)
