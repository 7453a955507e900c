"""Operator 10, chat formatting from raw transcripts.

A hidden Markov model reads a transcript line by line. Its states say who speaks and whether the line opens
a turn; what it sees of a line is the speaker marker (or none), whether a blank line came before, a question
mark at the end, the length class and list or code marks. Viterbi recovers the roles, also of turns whose
marker is missing or odd, and every turn is then rendered in one canonical form.

A conversation of any length is one decoding. Its text lies in segments, which tasks share; each segment of a long
conversation is first reduced to a matrix of the best scores between the states before it and at its end, these few
numbers are chained conversation by conversation, and every segment is then decoded between the scores and the state
that the whole gives it. Log probabilities are multiples of 2^-20, so sums are exact and no cut changes a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamlake.llm.common import cut, table

ROLES = ("system", "user", "assistant")
#: Names that speakers go by in transcripts.
SPEAKERS = {
    "system": ("system", "instruction", "instructions", "context"),
    "user": ("user", "human", "you", "question", "q", "customer", "me", "prompter"),
    "assistant": ("assistant", "ai", "bot", "answer", "a", "agent", "model", "chatbot"),
}
_BY_NAME = {n: i for i, r in enumerate(ROLES) for n in SPEAKERS[r]}
_NAMES = "|".join(sorted(_BY_NAME, key=len, reverse=True))
#: "User: text", "**User**: text", "[user] text", "<|user|>" alone, "### User:" alone.
MARKER = re.compile(rf"(?i)^\s*(?:(?:[#>*_]+\s*)*({_NAMES})\s*[*_]*\s*:[*_]*|\[({_NAMES})\]:?|<\|(?:im_start\|>)?({_NAMES})(?:\|>|\b)|#+\s*({_NAMES})\s*$)[ \t]?")
LISTED = re.compile(r"^\s*(?:[-*+]\s|\d+[.)]\s|```|    )")

#: State 2r opens a turn of role r, state 2r + 1 continues it.
STATES = 2 * len(ROLES)
FEATURES = (len(ROLES) + 1, 2, 2, 4, 2)  # marker, blank before, question, length class, list or code

#: Conversations that a fit reads at most, those whose ids hash lowest; turns whose marker a fit hides.
FIT_CONVERSATIONS = 1_000
HIDDEN_SHARE = 0.15
#: Turns of one conversation in one row; what is decoded is the whole conversation.
SEGMENT_TURNS = 256
#: Parts that the segments of a conversation are dealt to where they are matched with it.
SALTS = 16
#: So that sums of log probabilities are exact in doubles.
STEP = 2.0**-20

OUT = "n_lines long, roles array<string>, turns array<struct<role:string,text:string>>, line_roles string, rendered string"
#: Markers of odd transcripts, one of which is no marker at all.
ODD = {
    "system": ("System: ", "### System:\n", "[system] ", ""),
    "user": ("Human: ", "**User**: ", "<|user|>\n", "[user] ", "Q: ", ""),
    "assistant": ("AI: ", "### Assistant:\n", "<|im_start|>assistant\n", "Bot: ", "A: ", ""),
}


@dataclass(frozen=True)
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: tuple[np.ndarray, ...]


def observe(lines: Sequence[str]) -> tuple[np.ndarray, list[str], list[int]]:
    """Feature rows of the lines that aren't blank, those lines without their markers, and their positions."""
    rows, bodies, places, blank = [], [], [], True
    for i, line in enumerate(lines):
        if not line.strip():
            blank = True
            continue
        m = MARKER.match(line)
        body = line[m.end() :] if m else line
        role = _BY_NAME[next(g for g in m.groups() if g).lower()] if m else len(ROLES)
        size = len(body.strip())
        rows.append((role, int(blank), int(body.rstrip().endswith("?")), 0 if size < 20 else 1 if size < 80 else 2 if size < 300 else 3, int(bool(LISTED.match(body)))))
        bodies.append(body)
        places.append(i)
        blank = False
    return np.array(rows, np.int64).reshape(-1, len(FEATURES)), bodies, places


def fit(conversations: Sequence[Sequence[tuple[str, str]]], hidden: float = HIDDEN_SHARE) -> Model:
    """Counts of states and features, plus one, over labelled conversations of (role, text) turns.

    In a share of the turns, told by their number, the marker is hidden, so the model learns what an opening
    line without one looks like.
    """
    start, move = np.ones(STATES), np.ones((STATES, STATES))
    start[1::2] = 1e-3
    for s in range(STATES):  # a line continues its own turn or opens another
        move[s, [t for t in range(STATES) if t % 2 and t // 2 != s // 2]] = 1e-6
    emit = tuple(np.ones((STATES, n)) for n in FEATURES)
    number = 0
    for turns in conversations:
        lines, states = [], []
        for role, text in turns:
            if role not in ROLES or not text or not text.strip():
                continue
            r, number = ROLES.index(role), number + 1
            marked = (number * 2654435761 % 2**32) / 2**32 >= hidden
            body = [x for x in text.split("\n") if x.strip()]
            lines += ["", *((f"{role}: {x}" if marked and not k else x) for k, x in enumerate(body))]
            states += [2 * r + (k > 0) for k in range(len(body))]
        features, _, _ = observe(lines)
        for i, s in enumerate(states):
            if i:
                move[states[i - 1], s] += 1
            else:
                start[s] += 1
            for f, table_ in enumerate(emit):
                table_[s, features[i, f]] += 1
    logs = lambda x: np.round(np.log(x / x.sum(axis=-1, keepdims=True)) / STEP) * STEP
    return Model(logs(start), logs(move), tuple(map(logs, emit)))


def _seen(model: Model, features: np.ndarray) -> np.ndarray:
    return sum(e[:, features[:, f]] for f, e in enumerate(model.emit)).T


def viterbi(model: Model, features: np.ndarray, entry: Sequence[float] | None = None, end: int | None = None) -> np.ndarray:
    """The likeliest states; of equally likely ones the lowest.

    entry: scores of the states before the first line, if lines came before. end: the state of the last line, if it is known.
    """
    n = len(features)
    if not n:
        return np.empty(0, np.int64)
    seen = _seen(model, features)
    back = np.zeros((n, STATES), np.int8)
    score = (model.start if entry is None else (np.array(entry)[:, None] + model.move).max(axis=0)) + seen[0]
    for i in range(1, n):
        ways = score[:, None] + model.move
        back[i] = ways.argmax(axis=0)
        score = ways.max(axis=0) + seen[i]
    states = np.empty(n, np.int64)
    states[-1] = score.argmax() if end is None else end
    for i in range(n - 1, 0, -1):
        states[i - 1] = back[i, states[i]]
    return states


def transfer(model: Model, features: np.ndarray) -> np.ndarray | None:
    """[i, j]: the best score of the lines if the state before them is i and their last one j; null without lines."""
    best = None
    for row in _seen(model, features) if len(features) else ():
        best = model.move + row if best is None else (best[:, :, None] + model.move[None]).max(axis=1) + row
    return best


def chain(model: Model, parts: Sequence[tuple[np.ndarray | None, np.ndarray | None]]) -> list[tuple[list[float] | None, int | None]]:
    """For the segments of one conversation in order: the scores of the states before each, and the state at its end.

    parts: (opening, matrix): transfer() of each segment, and the scores that its lines would have as the first of a
    conversation, of which only those of the first segment with lines count.
    """
    scores: list[np.ndarray | None] = [None]
    for opening, matrix in parts:
        before = scores[-1]
        scores.append(before if matrix is None else opening if before is None else (before[:, None] + matrix).max(axis=0))
    ends: list[int | None] = [None] * len(parts)
    state = None
    for k in range(len(parts) - 1, -1, -1):
        matrix, before = parts[k][1], scores[k]
        if matrix is None:
            continue
        ends[k] = int(scores[k + 1].argmax()) if state is None else state
        if before is not None:
            state = int((before + matrix[:, ends[k]]).argmax())
    return [(None if b is None else b.tolist(), e) for b, e in zip(scores, ends)]


def parse(model: Model, transcript: str | None, entry: Sequence[float] | None = None, end: int | None = None) -> tuple[int, list[tuple[str, str]]]:
    """The number of lines with text, and the (role, text) turns; blank lines within a turn stay. entry, end: see viterbi."""
    lines = (transcript or "").split("\n")
    features, bodies, places = observe(lines)
    turns: list[tuple[str, list[str]]] = []
    last = -1
    for state, body, place in zip(viterbi(model, features, entry, end).tolist(), bodies, places, strict=True):
        role = ROLES[state // 2]
        if state % 2 == 0 or not turns or turns[-1][0] != role:
            turns.append((role, [body]))
        else:
            turns[-1][1].extend([""] * (place - last - 1) + [body])
        last = place
    return len(bodies), [(r, "\n".join(t)) for r, t in turns]


def render(turns: Sequence[tuple[str, str]]) -> str:
    """The canonical form; what looks like a control mark in a text is broken up, so no text can open a turn."""
    return "".join(f"<|{role}|>\n{text.replace('<|', '< |')}\n<|end|>\n" for role, text in turns)


def parse_transcripts(df: DataFrame, model: Model, transcript: str = "transcript", out: str = "chat", entry: str | None = None, end: str | None = None) -> DataFrame:
    """df with a struct ``out`` of OUT (a column of that name is replaced). line_roles: the first letter of each line's role.

    A null or blank transcript has no lines and no turns and renders as the empty string. Rows are parsed on their own,
    where ``entry`` and ``end`` name columns, between what these say of their conversation (see decode_segments).
    """

    @F.pandas_udf(OUT)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for texts, before, after in batches:
            parsed = [parse(model, t, b, None if pd.isna(e) else int(e)) for t, b, e in zip(texts, before, after, strict=True)]
            yield pd.DataFrame(
                {
                    "n_lines": [n for n, _ in parsed],
                    "roles": [[r for r, _ in turns] for _, turns in parsed],
                    "turns": [[{"role": r, "text": t} for r, t in turns] for _, turns in parsed],
                    "line_roles": ["".join(r[0] * sum(1 for x in t.split("\n") if x.strip()) for r, t in turns) for _, turns in parsed],
                    "rendered": [render(turns) for _, turns in parsed],
                }
            )

    before = F.col(entry) if entry else F.lit(None).cast("array<double>")
    after = F.col(end) if end else F.lit(None).cast("int")
    return df.withColumn(out, run(F.col(transcript).cast("string"), before, after))


def _summaries(segments: DataFrame, model: Model, transcript: str) -> DataFrame:
    """segments with opening and matrix (36 numbers), null without lines."""

    @F.pandas_udf("opening array<double>, matrix array<double>")
    def run(texts: pd.Series) -> pd.DataFrame:
        found = []
        for t in texts:
            features, _, _ = observe((t or "").split("\n"))
            matrix = transfer(model, features)
            if matrix is None:
                found.append((None, None))
                continue
            # the scores of a conversation that begins here: as if the state before the first line gave the start
            score = model.start + _seen(model, features[:1])[0]
            rest = transfer(model, features[1:])
            found.append(((score if rest is None else (score[:, None] + rest).max(axis=0)).tolist(), matrix.ravel().tolist()))
        return pd.DataFrame(found, columns=["opening", "matrix"])

    return segments.withColumn("_s", run(F.col(transcript))).select("*", "_s.*").drop("_s")


def _split(df: DataFrame, long: DataFrame, conv: Column, segment: Column) -> tuple[DataFrame, DataFrame]:
    """The rows of df that belong to a conversation in long, and the others.

    A conversation of very many rows is spread over the joins by the numbers of its segments. Rows without a
    segment (-1) or a conversation are among the others.
    """
    keys = long.select(F.col("conv_id").alias("_c"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_x"))
    met = (conv == F.col("_c")) & (F.pmod(segment, F.lit(SALTS)).cast("int") == F.col("_x")) & (segment >= 0)
    return df.join(keys, met, "left_semi"), df.join(keys, met, "left_anti")


def _whole(mine: DataFrame, model: Model, outs: dict[str, str]) -> DataFrame:
    """mine, a written table of the segments of long conversations, with a decoding of each transcript column in outs:
    each conversation decoded as one.

    42 numbers for each segment meet in one task by conversation, never a text.
    """

    @F.pandas_udf("array<struct<segment:long,entry:array<double>,end:int>>")
    def chained(parts: pd.Series) -> pd.Series:
        outs = []
        for xs in parts:
            array = lambda v, *shape: None if v is None else np.array(v, np.float64).reshape(shape)
            told = chain(model, [(array(x["opening"], STATES), array(x["matrix"], STATES, STATES)) for x in xs])
            outs.append([{"segment": x["segment"], "entry": e, "end": d} for x, (e, d) in zip(xs, told, strict=True)])
        return pd.Series(outs, dtype=object)

    whole = mine
    for transcript, out in outs.items():
        told = _summaries(mine.select("conv_id", "segment", transcript), model, transcript).select("conv_id", F.struct("segment", "opening", "matrix").alias("x"))
        told = told.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("xs")).select("conv_id", F.explode(chained("xs")).alias("t"))
        told = told.select("conv_id", F.col("t.segment").alias("segment"), F.col("t.entry").alias("_entry"), F.col("t.end").alias("_end"))
        whole = parse_transcripts(whole.join(told, ["conv_id", "segment"]).select(*whole.columns, "_entry", "_end"), model, transcript, out, "_entry", "_end").drop("_entry", "_end")
    return whole


def decode_segments(segments: DataFrame, model: Model, long: DataFrame, transcript: str = "transcript", out: str = "chat") -> DataFrame:
    """segments (conv_id, segment, ...) with ``out``; those of the conversations in ``long`` are decoded as one."""
    if long.isEmpty():
        return parse_transcripts(segments, model, transcript, out)
    mine, rest = _split(segments, long, F.col("conv_id"), F.col("segment"))
    return parse_transcripts(rest, model, transcript, out).unionByName(_whole(cut(mine), model, {transcript: out}))


def _chats(conversations: DataFrame, model: Model, outs: dict[str, str]) -> DataFrame:
    """to_transcripts of conversations with a decoding of each transcript column in outs. Only long conversations are
    written before they are decoded; rows are told apart before any are gathered, so each is gathered once."""
    conversations = conversations.select("conv_id", "turn", "role", "text")
    odd, long = "odd_transcript" in outs, cut(long_conversations(conversations))
    mine, rest = _split(conversations, long, F.col("conv_id"), segment_of(F.col("turn")))
    short = to_transcripts(conversations if long.isEmpty() else rest, odd=odd)
    for transcript, out in outs.items():
        short = parse_transcripts(short, model, transcript, out)
    if long.isEmpty():
        return short
    return short.unionByName(_whole(cut(to_transcripts(mine, odd=odd)), model, outs))


def _odd(conv: Column, turn: Column, role: Column) -> Column:
    """A marker that the hash of the turn's place chooses; in a share of the turns none."""
    at = F.xxhash64(conv, turn)
    pick = lambda styles: F.element_at(F.array(*map(F.lit, styles)), F.pmod(at, F.lit(len(styles))).cast("int") + 1)
    found = F.lit("")
    for name, styles in ODD.items():
        found = F.when(role == name, pick(styles)).otherwise(found)
    return found


def to_transcripts(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", odd: bool = False) -> DataFrame:
    """(conv_id, segment, n_turns, transcript): turns in order, a blank line between them, marked where the role is known.

    A conversation is cut into segments by its turn numbers, so that no task holds one of any length. Equal
    turn numbers stand by role and text. Rows without a turn number come in segment -1; of those, and of rows
    without a conversation, each is a transcript of its own. Turns without text have none.
    odd adds odd_transcript, in which markers vary and some are missing, and truth, the first letter of the true role
    (or ?) of each of its lines with text.
    """
    alone = F.col(conv).isNull() | F.col(turn).isNull()
    body = F.regexp_replace(F.col(text), r"\n(?=[ \t]*\n)", "")
    line = F.concat(F.when(F.col(role).isin(*ROLES), F.concat(F.col(role), F.lit(": "))).otherwise(F.lit("")), body)
    fields = [F.col(turn).alias("t"), F.col(role).alias("r"), line.alias("line")]
    if odd:
        lines = F.size(F.filter(F.split(body, "\n"), lambda x: F.trim(x) != ""))
        letter = F.when(F.col(role).isin(*ROLES), F.substring(role, 1, 1)).otherwise(F.lit("?"))
        fields += [F.concat(_odd(F.col(conv), F.col(turn), F.col(role)), body).alias("odd"), F.repeat(letter, F.coalesce(lines, F.lit(0))).alias("truth")]
    said = conversations.select(F.col(conv).alias("conv_id"), segment_of(F.col(turn)).alias("segment"), F.when(alone, F.monotonically_increasing_id()).alias("row"), F.struct(*fields).alias("x"))
    grouped = said.groupBy("conv_id", "segment", "row").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    joined = lambda f: F.array_join(F.filter(F.transform("xs", lambda x: x[f]), lambda s: s.isNotNull()), "\n\n")
    more = [joined("odd").alias("odd_transcript"), F.array_join(F.transform("xs", lambda x: x["truth"]), "").alias("truth")] if odd else []
    return grouped.select("conv_id", "segment", F.size("xs").cast("long").alias("n_turns"), joined("line").alias("transcript"), *more)


def segment_of(turn: Column) -> Column:
    return F.when(turn.isNull(), F.lit(-1)).otherwise(F.floor(turn / SEGMENT_TURNS)).cast("long")


def long_conversations(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv_id) of those with turns in more than one segment."""
    sides = conversations.where(F.col(conv).isNotNull() & F.col(turn).isNotNull()).groupBy(F.col(conv).alias("conv_id")).agg(F.min(turn).alias("lo"), F.max(turn).alias("hi"))
    return sides.where(segment_of(F.col("lo")) != segment_of(F.col("hi"))).select("conv_id")


def fit_on(conversations: DataFrame, most: int = FIT_CONVERSATIONS) -> Model:
    """fit() on at most ``most`` labelled conversations with at most SEGMENT_TURNS turns each."""
    valid = conversations.where(F.col("role").isin(*ROLES) & F.col("text").isNotNull() & F.col("turn").between(0, SEGMENT_TURNS - 1))
    ids = valid.select("conv_id").where("conv_id is not null").distinct().orderBy(F.xxhash64("conv_id"), "conv_id").limit(most)
    # of clashing turns the first by role and text, so that the same table always fits the same model
    rows = valid.join(F.broadcast(ids), "conv_id").groupBy("conv_id", "turn").agg(F.min(F.struct("role", "text")).alias("x")).select("conv_id", "turn", "x.role", "x.text").collect()
    by: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r["conv_id"], r["turn"])):
        by.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    return fit(list(by.values()))


def format_chats(conversations: DataFrame, model: Model | None = None) -> DataFrame:
    """(conv_id, segment, n_turns, chat) of conversations (conv_id, turn, role, text), see to_transcripts and OUT; no rows give none.

    The rows of one conversation are one decoding; one after the other, they are what a single row would be.
    """
    model = fit_on(conversations) if model is None else model
    return _chats(conversations, model, {"transcript": "chat"}).drop("transcript")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation twice: as marked as the table is (roles, rendered), and with its markers varied or gone, of
    which odd_roles are what the model recovers and right_lines how many lines of n_lines have their true role."""
    table_ = table(spark, sf_dir, "conversations")
    chats = _chats(table_, fit_on(table_), {"transcript": "chat", "odd_transcript": "odd"})
    same = F.filter(F.sequence(F.lit(1), F.length("truth")), lambda i: F.substring("odd.line_roles", i, F.lit(1)) == F.substring("truth", i, F.lit(1)))
    return chats.select(
        "conv_id", "segment", "n_turns", "chat.n_lines", F.array_join("chat.roles", ",").alias("roles"), "chat.rendered", F.array_join("odd.roles", ",").alias("odd_roles"), F.col("odd.rendered").alias("odd_rendered"),
        F.when(F.length("truth") > 0, F.size(same)).otherwise(F.lit(0)).cast("long").alias("right_lines"),
    )


#: SQL can't run the model; the tests compare with brute force, with a single decoding and with the roles of the table.
SQL: dict[str, str] = {}
QUERIES = {"op10_chat_format": op10_chat_format}
