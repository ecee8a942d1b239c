"""Chat formatting: roles of raw transcripts recovered by a hidden Markov model.

A transcript is a text of lines. States are (role, first line of a turn) and
(role, later line); a line's emission multiplies categorical features: the
speaker marker it opens with, whether a blank line precedes it, its length and
its last character. Transition and emission tables are supervised counts with
add-half smoothing over at most ``TRAIN_CONVERSATIONS`` labelled conversations.
Viterbi names the best state path; markers are cut off and the turns rendered
canonically.

Long transcripts are decoded in windows of ``WINDOW`` turns that see ``MARGIN``
turns on either side, so no conversation, however many turns one key holds, is
gathered whole; up to ``WINDOW`` turns the path is the exact Viterbi path.
Windows with more than ``PART_ROWS`` rows, as null or repeated turn numbers and
null ids can make, are dealt over parts by the hash of their rows.

Conversations whose crc32(conv_id as text) mod 3 is 1 are held out of training.

Defined results: null texts are empty turns, null turns sort first, equal turns
are ordered by role and text, null roles are not trained on and never count as
recovered; rows without a conv_id are one conversation; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockquery.session import stored, table

ROLES = ("system", "user", "assistant")
WINDOW, MARGIN = 512, 32
PART_ROWS = 4 * WINDOW
BROADCAST_KEYS = 200_000
TRAIN_CONVERSATIONS = 300
END = "<|end|>"

#: how a transcript marks each role's turns; {} takes the turn's text
STYLES = (
    {"system": "System: {}", "user": "User: {}", "assistant": "Assistant: {}"},
    {"system": "[Instructions] {}", "user": "Human: {}", "assistant": "AI: {}"},
    {"system": "### System\n{}", "user": "### User\n{}", "assistant": "### Assistant\n{}"},
    {"system": "{}", "user": "Q: {}", "assistant": "A: {}"},
    {"system": "**System:** {}", "user": "**Customer:** {}", "assistant": "**Agent:** {}"},
    {"system": "{}", "user": "{}", "assistant": "{}"},
)
MARKER = re.compile(
    r"\s*(?:#{1,4}\s*|\*\*|\[|<\|?)?(?P<name>system|instructions|user|human|customer|q|assistant|ai|agent|bot|a)"
    r"(?:\]|\|?>|:\*\*|\*\*:?|:|(?=\s*$))\s*",
    re.I | re.A,
)
_LENGTHS = np.array([1, 40, 80, 160, 240, 320, 480, 640, 960])


def transcript(turns: list[tuple[str, str]], style: dict[str, str]) -> str:
    """Raw text of labelled turns in one of the styles, a blank line between turns."""
    return "\n\n".join(style[role].format(text) for role, text in turns)


def features(lines: list[str]) -> list[tuple]:
    """Categorical features of each line."""
    out, gap = [], True
    for line in lines:
        mark = MARKER.match(line)
        body = line[mark.end() :] if mark else line
        name = mark["name"].lower() if mark and (mark["name"].lower() not in ("q", "a") or line[mark.end("name")] in ":]") else ""
        out.append((name, gap, int(np.searchsorted(_LENGTHS, len(body), "right")), body[-1:] if body[-1:] in "?.!:" else ""))
        gap = not line.strip()
    return out


def _labelled_lines(turns: list[tuple[str, str]], style: dict[str, str]) -> tuple[list[str], list[int]]:
    """Lines of a transcript and their states: 2*role for a turn's first line, 2*role+1 for the others."""
    lines, states = [], []
    for role, text in turns:
        if lines:
            lines.append("")
            states.append(states[-1] | 1)
        own = style[role].format(text).split("\n")
        first = 2 * ROLES.index(role)
        lines += own
        states += [first] + [first + 1] * (len(own) - 1)
    return lines, states


class RoleModel:
    """Log tables of the model, frozen after training."""

    STATES = 2 * len(ROLES)

    def __init__(self, counts: dict[tuple[str, int, str], int]):
        """counts: (table, state, value) -> n, for "start", "next" and "f0".. tables."""
        n = self.STATES
        self.start = np.full(n, 0.5)
        self.move = np.full((n, n), 0.02)
        emit: dict[str, dict[str, np.ndarray]] = {}
        for (name, state, value), k in counts.items():
            if name == "start":
                self.start[state] += k
            elif name == "next":
                self.move[state, int(value)] += k
            else:
                emit.setdefault(name, {}).setdefault(value, np.zeros(n))[state] += k
        self.start = np.log(self.start / self.start.sum())
        self.move = np.log(self.move / self.move.sum(axis=1, keepdims=True))
        self.emit, self.other = [], []
        for k in range(4):
            values = emit.get(f"f{k}", {})
            total = sum(values.values(), np.zeros(n)) + 0.5 * (len(values) + 1)
            self.emit.append({v: np.log((c + 0.5) / total) for v, c in values.items()})
            self.other.append(np.log(0.5 / total))

    def viterbi(self, lines: list[str]) -> list[int]:
        """The most likely states; ties go to the lower state."""
        if not lines:
            return []
        best, back = None, []
        for f in features(lines):
            local = sum((self.emit[k].get(str(v), self.other[k]) for k, v in enumerate(f)), np.zeros(self.STATES))
            if best is None:
                best = self.start + local
            else:
                step = best[:, None] + self.move
                back.append(step.argmax(axis=0))
                best = step.max(axis=0) + local
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]

    def parse(self, text: str) -> list[tuple[str, str]]:
        """(role, text) turns of a raw transcript."""
        lines = text.split("\n")
        turns: list[tuple[str, list[str]]] = []
        previous = None
        for line, state in zip(lines, self.viterbi(lines), strict=True):
            if state % 2 == 0 or previous is None or state // 2 != previous:
                mark = MARKER.match(line)
                body = line[mark.end() :] if mark else line
                turns.append((ROLES[state // 2], [] if mark and not body else [body]))
            else:
                turns[-1][1].append(line)
            previous = state // 2
        return [(role, "\n".join(body).removesuffix("\n") if k < len(turns) - 1 else "\n".join(body)) for k, (role, body) in enumerate(turns)]


def render(turns: list[tuple[str, str]]) -> str:
    """Canonical form: ``<|role|>``, the text, ``<|end|>``, each on lines of their own.

    Within a text ``<|`` becomes ``<||``, so that no text can hold a marker.
    """
    return "".join(f"<|{role}|>\n{escaped(text)}\n{END}\n" for role, text in turns)


def escaped(text: str) -> str:
    return text.replace("<|", "<||")


def held_out(conv_id) -> F.Column:
    """Conversations that no model is trained on; a null id is not held out."""
    return F.coalesce(F.crc32(conv_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _style(conv_id) -> dict[str, str]:
    return STYLES[int.from_bytes(sha256(str(conv_id).encode()).digest()[:4], "big") % len(STYLES)]


def _windowed(conversations: DataFrame) -> DataFrame:
    """Rows with their place in the conversation, one copy for each window that sees them."""
    turns = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    # Places by turn number: numbers are used as they are when they are the places, so no window function gathers a key.
    place = F.greatest(F.coalesce(F.col("turn"), F.lit(0)), F.lit(0))
    seen = F.sequence(F.floor(F.greatest(place - MARGIN, F.lit(0)) / WINDOW), F.floor((place + MARGIN) / WINDOW))
    rows = turns.withColumn("window", F.explode(seen)).withColumn("own", F.floor(place / WINDOW) == F.col("window"))
    keys = ["conv_id", "window"]
    large = rows.groupBy(*keys).agg(F.count("*").alias("rows")).where(F.col("rows") > PART_ROWS)
    large = large.select(F.col("conv_id").alias("id"), F.col("window").alias("at"), "rows")
    large = stored(large, "large-windows")
    n = large.count()
    if not n:
        return rows.withColumn("part", F.lit(0).cast("long"))
    large = F.broadcast(large) if n <= BROADCAST_KEYS else large
    part = F.pmod(F.xxhash64("turn", "role", "text"), F.ceil(F.col("rows") / WINDOW))
    met = rows.join(large, rows.conv_id.eqNullSafe(large.id) & (rows.window == large["at"]), "left")
    return met.withColumn("part", F.coalesce(part, F.lit(0)).cast("long")).drop("id", "at", "rows")


def _groups(batches, keys: tuple[str, ...]):
    """Consecutive rows with equal keys out of sorted Arrow batches, as lists of dicts."""
    current, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if rows and key != current:
                yield current, rows
                rows = []
            current = key
            rows.append(row)
    if rows:
        yield current, rows


def train(conversations: DataFrame, limit: int = TRAIN_CONVERSATIONS) -> RoleModel:
    """Tables from at most ``limit`` conversations, those with the lowest hash of their id, in every style."""
    labelled = conversations.where(F.col("role").isin(*ROLES) & F.col("conv_id").isNotNull() & ~held_out(F.col("conv_id")))
    ids = labelled.select("conv_id").distinct().orderBy(F.xxhash64("conv_id"), "conv_id").limit(limit)
    rows = _windowed(labelled.join(F.broadcast(ids), "conv_id", "left_semi")).where("own")
    rows = rows.repartition("conv_id", "window", "part").sortWithinPartitions("conv_id", "window", "part", "turn", "role", "text")

    def run(batches):
        import pyarrow as pa

        counts: dict[tuple[str, int, str], int] = {}
        for (_, window, _), group in _groups(batches, ("conv_id", "window", "part")):
            turns = [(r["role"], r["text"]) for r in group]
            for style in STYLES:
                lines, states = _labelled_lines(turns, style)
                found = [] if window else [("start", states[0], "")]
                found += [("next", a, str(b)) for a, b in zip(states, states[1:], strict=False)]
                found += [(f"f{k}", s, str(v)) for f, s in zip(features(lines), states, strict=True) for k, v in enumerate(f)]
                for x in found:
                    counts[x] = counts.get(x, 0) + 1
        names, states, values = zip(*counts, strict=True) if counts else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(states, pa.int64()), pa.array(values, pa.string()), pa.array(list(counts.values()), pa.int64())],
            names=["name", "state", "value", "n"],
        )

    summed = rows.mapInArrow(run, "name string, state long, value string, n long").groupBy("name", "state", "value").agg(F.sum("n").alias("n"))
    return RoleModel({(r["name"], r["state"], r["value"]): r["n"] for r in summed.collect()})


def recover_roles(conversations: DataFrame, model: RoleModel) -> DataFrame:
    """Per (conv_id, window, part): its turns written as a raw transcript, parsed back and rendered canonically.

    Columns: conv_id, window, part, held_out (of training), n_turns, n_found (turns that the parse gives),
    n_recovered (turns whose role and text come back), roles, rendered_sha256.
    """
    rows = _windowed(conversations).withColumn("held_out", held_out(F.col("conv_id")))
    rows = rows.repartition("conv_id", "window", "part").sortWithinPartitions("conv_id", "window", "part", "turn", "role", "text")
    kind = conversations.schema["conv_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        out: list[tuple] = []
        for (conv_id, window, part), group in _groups(batches, ("conv_id", "window", "part")):
            own = [k for k, r in enumerate(group) if r["own"]]
            if not own:
                continue
            style = _style(conv_id)
            turns = [(r["role"] if r["role"] in ROLES else "user", r["text"]) for r in group]
            parsed = model.parse(transcript(turns, style))
            if len(parsed) == len(turns):
                mine = parsed[own[0] : own[-1] + 1]
            else:  # a line was taken for a turn or the other way round: align by the margin before
                mine = parsed[own[0] : len(parsed) - (len(turns) - 1 - own[-1])]
            truth = [(group[k]["role"], group[k]["text"]) for k in own]
            hits = sum(a == b for a, b in zip(mine, truth, strict=False))
            roles = ",".join(r for r, _ in mine)
            out.append((conv_id, window, part, group[0]["held_out"], len(truth), len(mine), hits, roles, sha256(render(mine).encode()).hexdigest()))
            if len(out) == 1000:
                yield _batch(pa, out, kind)
                out = []
        if out:
            yield _batch(pa, out, kind)

    schema = f"conv_id {kind}, window long, part long, held_out boolean, n_turns long, n_found long, n_recovered long, roles string, rendered_sha256 string"
    return rows.mapInArrow(run, schema)


def _batch(pa, rows: list[tuple], kind: str):
    names = ["conv_id", "window", "part", "held_out", "n_turns", "n_found", "n_recovered", "roles", "rendered_sha256"]
    types = [pa.int64() if kind == "bigint" else pa.string() if kind == "string" else None] + [pa.int64()] * 2 + [pa.bool_()] + [pa.int64()] * 3 + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return recover_roles(conversations, train(conversations))


QUERIES = {"op10_chat_format": op10_chat_format}
