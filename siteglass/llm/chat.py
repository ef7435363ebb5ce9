"""Chat transcripts: roles recovered by a hidden Markov model, turns rendered in one canonical form.

A line's hidden state is the role that speaks and whether its turn begins there. Observed are the class of speaker marker, the
length and whether the line asks. Counts of labelled transcripts give the probabilities. A long transcript is cut into blocks of rows by position; a block
sums up the best path from each state before it to each state at its end, the blocks of a transcript are chained, and each
block is then decoded between its fixed ends. So a transcript of any length is decoded exactly, and no task holds more than blocks.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.ordered import BEFORE, ranked
from .common import fold, kept

ROLES = ("system", "user", "assistant")
#: States: begin of a turn of each role, then inside of it; one more stands for the time before the first line.
STATES = len(ROLES) * 2
BLOCK = 64

#: Words that mark speakers.
MARKERS = {
    1: ("system", "instructions", "instruction", "context"),
    2: ("user", "human", "q", "question", "customer", "me"),
    3: ("assistant", "ai", "bot", "a", "answer", "agent", "model"),
}
ANY_MARKER = re.compile(r"^\s*(?:\[|<\|?|\*\*|### ?)?\s*([A-Za-z]{1,12})\s*(?:\]|\|?>|\*\*)?\s*(:|>|\]|\|>)\s*")
MARKER_CLASSES, LENGTHS = 5, 4


def marker(line: str) -> tuple[int, int]:
    """Class of the speaker marker (0 none, 4 a word that no role is known by) and where the text after it begins."""
    found = ANY_MARKER.match(line)
    if not found:
        return 0, 0
    word = found[1].lower()
    kind = next((k for k, words in MARKERS.items() if word in words), 4)
    return kind, found.end() if kind < 4 else 0


def observed(line: str) -> int:
    """Symbol of a line: marker class, length class and whether it asks."""
    kind, start = marker(line)
    rest = line[start:].strip()
    size = 0 if not rest else min(3, 1 + (len(rest) > 60) + (len(rest) > 240))
    return (kind * LENGTHS + size) * 2 + ("?" in rest)


SYMBOLS = MARKER_CLASSES * LENGTHS * 2


def lines_of(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, place, block) of distinct turns. The place is the row's number in its transcript, from 0, by turn (null
    first), role, and hash of the text; a block is BLOCK places.

    Rows are numbered inside ranges of turns, and there inside ranges of hashes for each turn and role, so rows of one turn, or of all
    null ids, never come together.
    """
    lines = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    cut = lines.withColumn("_range", F.floor(F.col("turn") / BLOCK)).withColumn("_hash", F.xxhash64("text"))
    inside = ranked(cut, ["conv_id", "_range"], F.struct("turn", "role", F.shiftright("_hash", 52)), [F.col(c) for c in ("turn", "role", "_hash", "text")], "_in")
    before = Window.partitionBy("conv_id").orderBy("_range").rowsBetween(*BEFORE)
    sizes = cut.groupBy("conv_id", "_range").agg(F.count("*").alias("_n"))
    starts = sizes.select(F.col("conv_id").alias("_c"), F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    placed = inside.join(starts, F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("_range").eqNullSafe(F.col("_r")))
    return placed.select("conv_id", "turn", "role", "text", (F.col("_start") + F.col("_in") - 1).alias("place")).withColumn("block", F.floor(F.col("place") / BLOCK))


def as_transcripts(turns: DataFrame, unmarked: int = 4) -> DataFrame:
    """Transcript pieces (conv_id, turn, role, text, place, block) as people paste them: markers of a style that depends on the transcript; one
    turn in ``unmarked`` has none. The role stays beside the text only for learning and for tests."""
    styles = [("System: ", "User: ", "Assistant: "), ("[system] ", "[human] ", "[bot] "), ("Context: ", "Q: ", "A: "), ("**system**: ", "**me**: ", "**ai**: "), ("<|system|> ", "<|customer|> ", "<|agent|> ")]
    style = F.abs(F.xxhash64("conv_id", F.lit("style"))) % len(styles)
    mark = F.lit("")
    for s, marks in enumerate(styles):
        for role, word in zip(ROLES, marks):
            mark = F.when((style == s) & (F.col("role") == role), word).otherwise(mark)
    bare = F.abs(F.xxhash64("conv_id", "turn", F.lit("bare"))) % unmarked == 0
    return lines_of(turns).withColumn("text", F.concat(F.when(bare, "").otherwise(mark), "text"))


def learn(pieces: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(transitions, emissions) as logarithms, from labelled pieces; row STATES of the transitions is the start.

    All labelled pieces are counted, with one half added to each count. A piece's forerunner is found by a join on its place, so a very long
    transcript does not come together, and pieces of equal number are not paired.
    """
    known = pieces.where(F.col("role").isin(*ROLES))
    state = F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.col("role")).cast("int") - 1

    def run(frames):
        for frame in frames:
            rows = [(int(s) + len(ROLES) * (i > 0), observed(line)) for s, text in zip(frame["state"], frame["text"]) for i, line in enumerate(text.split("\n"))]
            yield pd.DataFrame(rows, columns=["state", "symbol"]).value_counts().reset_index(name="n")

    emitted = known.select(state.alias("state"), "text").mapInPandas(run, "state int, symbol int, n bigint").groupBy("state", "symbol").agg(F.sum("n").alias("n")).collect()
    emissions = np.full((STATES, SYMBOLS), 0.5)
    for r in emitted:
        emissions[r.state, r.symbol] += r.n
    here = known.select("conv_id", "place", state.alias("state"), F.size(F.split("text", "\n")).alias("k"))
    before = here.select(F.col("conv_id").alias("c"), (F.col("place") + 1).alias("t"), F.col("state").alias("p"), (F.col("k") > 1).alias("long"))
    joined = here.join(before, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("place") == F.col("t")), "left")
    counts = joined.groupBy("p", "long", "state").agg(F.count("*").alias("n"), F.sum(F.col("k") - 1).alias("inner"), F.sum((F.col("k") > 1).cast("int")).alias("opened")).collect()
    transitions = np.zeros((STATES + 1, STATES))
    for s in range(len(ROLES)):  # a turn goes on, or another begins
        transitions[[s, s + len(ROLES)], s + len(ROLES)] = 0.5
        transitions[:, s] = 0.5
    for r in counts:
        source = STATES if r.p is None else r.p + len(ROLES) * bool(r.long)
        transitions[source, r.state] += r.n
        transitions[r.state, r.state + len(ROLES)] += r.opened
        transitions[r.state + len(ROLES), r.state + len(ROLES)] += r.inner - r.opened
    with np.errstate(divide="ignore"):
        return np.log(transitions / transitions.sum(1, keepdims=True)), np.log(emissions / emissions.sum(1, keepdims=True))


def best_paths(transitions: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Best score from each state before the lines (or the start) to each state at their end."""
    out = transitions + scores[0]
    for row in scores[1:]:
        out = (out[:, :, None] + transitions[None, :STATES]).max(1) + row
    return out


def viterbi(transitions: np.ndarray, scores: np.ndarray, entry: int, exit_state: int | None = None) -> list[int]:
    """Best states of the lines after state ``entry``, ending in ``exit_state`` if that is given; of equal ones the lowest."""
    value, back = transitions[entry] + scores[0], []
    for row in scores[1:]:
        ways = value[:, None] + transitions[:STATES]
        back.append(ways.argmax(0))
        value = ways.max(0) + row
    path = [int(value.argmax()) if exit_state is None else exit_state]
    for step in reversed(back):
        path.append(int(step[path[-1]]))
    return path[::-1]


def split_block(frame: pd.DataFrame) -> list[str]:
    """Lines of a block in order."""
    ordered = frame.sort_values("place")
    return [line for text in ordered["text"] for line in text.split("\n")]


def parse(pieces: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Recovered turns of transcripts: conv_id, turn (from 0), part, role, n_lines, text, rendered.

    ``pieces``: (conv_id, place, block, text) and more; the role is not read. A part is what a turn has of a block of
    pieces; almost every turn has one. The text is without its marker; ``rendered`` is the canonical form, with a header where the turn begins.
    """
    transitions, emissions = model
    score = lambda lines: emissions[:, [observed(x) for x in lines]].T
    kind = pieces.schema["conv_id"].dataType.simpleString()

    def summary(key, frame):
        return pd.DataFrame({"conv_id": [key[0]], "block": [key[1]], "paths": [best_paths(transitions, score(split_block(frame))).ravel().tolist()]})

    def chain(key, frame):
        frame = frame.sort_values("block")
        value, back = None, []
        for paths in frame["paths"]:
            m = np.array(paths).reshape(STATES + 1, STATES)
            if value is None:
                value = m[STATES]
                continue
            ways = value[:, None] + m[:STATES]
            back.append(ways.argmax(0))
            value = ways.max(0)
        ends = [int(value.argmax())]
        for step in reversed(back):
            ends.append(int(step[ends[-1]]))
        ends.reverse()
        return pd.DataFrame({"conv_id": [key[0]] * len(ends), "block": frame["block"].to_numpy(), "entry": [STATES, *ends[:-1]], "exit": ends})

    def decode(key, frame):
        lines = split_block(frame)
        entry, last = frame["entry"].iloc[0], frame["exit"].iloc[0]
        path = viterbi(transitions, score(lines), STATES if pd.isna(entry) else int(entry), None if pd.isna(last) else int(last))
        parts: list[list] = []
        for line, state in zip(lines, path):
            if state < len(ROLES) or not parts:
                parts.append([sum(p[1] for p in parts) + (state < len(ROLES)), state < len(ROLES), ROLES[state % len(ROLES)], []])
            parts[-1][3].append(line[marker(line)[1]:] if state < len(ROLES) else line)
        return pd.DataFrame([(key[0], key[1], n, begins, role, len(x), "\n".join(x)) for n, begins, role, x in parts], columns=["conv_id", "block", "local", "begins", "role", "n_lines", "text"])

    # A transcript of one block begins at the start and ends anywhere; only longer ones are summed up and chained.
    longer = pieces.groupBy("conv_id").agg(F.min("block").alias("low"), F.max("block").alias("high")).where("low < high").select(F.col("conv_id").alias("_c"))
    blocks = pieces.join(longer, F.col("conv_id").eqNullSafe(F.col("_c")), "left_semi").groupBy("conv_id", "block")
    paths = blocks.applyInPandas(summary, f"conv_id {kind}, block bigint, paths array<double>")
    # Of a block only its matrix goes on: one row for every BLOCK turns.
    ends = paths.groupBy("conv_id").applyInPandas(chain, f"conv_id {kind}, block bigint, entry int, exit int").withColumnsRenamed({"conv_id": "_c", "block": "_b"})
    bounded = pieces.join(ends, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b")), "left").drop("_c", "_b")
    parts = kept(bounded.groupBy("conv_id", "block").applyInPandas(decode, f"conv_id {kind}, block bigint, local int, begins boolean, role string, n_lines int, text string"), "chat-parts")
    begun = parts.groupBy("conv_id", "block").agg(F.max("local").alias("n"))
    order = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = begun.select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), F.coalesce(F.sum("n").over(order), F.lit(0)).alias("offset"))
    placed = parts.join(offsets, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b")))
    header = F.when(F.col("begins"), F.concat(F.lit("<|"), "role", F.lit("|>\n"))).otherwise("")
    return placed.select("conv_id", (F.col("offset") + F.col("local") - 1).cast("long").alias("turn"), F.col("block").alias("part"), "role", "n_lines", "text", F.concat(header, "text", F.lit("\n")).alias("rendered"))


def recover(turns: DataFrame, held_out=None) -> DataFrame:
    """Turn conversations (conv_id, turn, role, text) into transcripts, and recover their turns.

    Roles of conversations in ``held_out`` (a condition on conv_id; None: fold 1 of 3) teach nothing. Rows that repeat count once; null
    and empty texts are one empty line; null ids are one transcript, null turns stand first; unknown roles get no marker and teach nothing. An
    empty table gives an empty result. Other columns are ignored.
    """
    pieces = kept(as_transcripts(turns), "transcripts")
    return parse(pieces, learn(pieces.where(~(fold("conv_id", 3) == 1 if held_out is None else held_out))))
