"""Session state that follows a chat as its messages arrive.

The cues of a turn are column expressions, evaluated before the stateful step; the state
processors only remember. Within a batch rows are taken in turn order, across batches in order
of arrival, and a batch holds at most what its trigger admits.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import MapState

from parley import fixed
from parley.functions import cues
from parley.operators.replay import DYNAMIC, hear_personas
from parley.functions.text import slug, strip
from parley.operators.validate import valid_profiles
from parley.plans.sizes import checked_broadcast

WORLD = list(fixed.WORLD_DEFAULTS)


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _use_state_store(df: DataFrame) -> None:
    """Named states need the RocksDB store; it has to be set before the stream starts."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


#: Rows of a session that go out in one frame: each carries the turns before it.
CHUNK = 1_000
#: Turn numbers whose rows are put in order together.
CELL = 4_096
_INBOX = ("cell bigint, run int", "rows binary")


def in_order(frames: Iterator[pd.DataFrame], inbox: MapState) -> Iterator[pd.DataFrame]:
    """The rows of a session's batch by turn, in frames of bounded size.

    One frame is sorted as it is. Of several, the rows are laid into state by cells of turn numbers,
    a run for each frame and cell, and the cells come back one after another. So no more than a
    frame, or the runs of a cell, is in memory however long the session is.
    """
    first, second = next(frames, None), next(frames, None)
    if first is None:
        return
    if second is None:
        yield first.sort_values("turn", kind="stable")
        return
    runs: dict[int, int] = {}
    for frame in chain([first, second], frames):
        for cell, rows in frame.groupby(frame["turn"] // CELL, sort=False):
            run = runs.get(cell, 0)
            inbox.updateValue((int(cell), run), (pickle.dumps(rows),))
            runs[cell] = run + 1
    for cell in sorted(runs):
        parts = []
        for run in range(runs[cell]):
            parts.append(pickle.loads(bytes(inbox.getValue((int(cell), run))[0])))
            inbox.removeKey((int(cell), run))
        yield pd.concat(parts, ignore_index=True).sort_values("turn", kind="stable")


class PairMessages(StatefulProcessor):
    """Remembers the unanswered user message of a session."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "text string, turn bigint")
        self.inbox = handle.getMapState("inbox", *_INBOX)

    def handleInputRows(self, key, rows, timers) -> Iterator[pd.DataFrame]:
        held = self.open.get() if self.open.exists() else None
        for frame in in_order(rows, self.inbox):
            out = []
            for row in frame.itertuples(index=False):
                if row.by_user:
                    held = (row.text, row.turn)
                elif held is not None:
                    out.append((row.conv_id, row.user_id, row.turn, held[0], row.text))
                    held = None
            yield pd.DataFrame(out, columns=["conv_id", "user_id", "turn", "user", "assistant"])
        if held is None:
            self.open.clear()
        else:
            self.open.update((held[0], int(held[1])))

    def close(self) -> None:
        pass


def pair_stream(messages: DataFrame) -> DataFrame:
    """Answered turns of a message stream (conv_id, user_id, turn, role, text)."""
    _use_state_store(messages)
    role = F.lower("role")
    talk = messages.where(
        role.isin(fixed.USER_ROLES + fixed.ASSISTANT_ROLES) & (strip(F.col("text")) != "")
    ).select("conv_id", "user_id", "turn", "text", role.isin(fixed.USER_ROLES).alias("by_user"))
    return talk.groupBy("conv_id").transformWithStateInPandas(
        statefulProcessor=PairMessages(),
        outputStructType="conv_id bigint, user_id bigint, turn bigint, user string, assistant string",
        outputMode="Append",
        timeMode="None",
    )


class FollowSession(StatefulProcessor):
    """Remembers persona, names of dynamic personas, moods, scene, last turns and switch counts."""

    def __init__(self, initial_id: str, initial_name: str, pairs: int) -> None:
        self.initial = (initial_id, initial_name)
        self.pairs = pairs

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.persona = handle.getValueState("persona", "id string, name string")
        self.world = handle.getValueState("world", ", ".join(f"{w} string" for w in WORLD))
        self.names = handle.getMapState("names", "id string", "name string")
        self.moods = handle.getMapState("moods", "id string", "emotion string")
        self.counts = handle.getMapState("counts", "id string", "uses bigint")
        self.history = handle.getListState("history", "user string, assistant string")
        self.inbox = handle.getMapState("inbox", *_INBOX)

    def handleInputRows(self, key, rows, timers) -> Iterator[pd.DataFrame]:
        who = tuple(self.persona.get()) if self.persona.exists() else self.initial
        scene = list(self.world.get()) if self.world.exists() else list(fixed.WORLD_DEFAULTS.values())
        past = [tuple(p) for p in self.history.get()]
        columns = ["conv_id", "turn", "user", "assistant", "character_id", "character_name", "emotion"]
        columns += [*WORLD, "uses", "history"]
        out = []
        for row in chain.from_iterable(f.itertuples(index=False) for f in in_order(rows, self.inbox)):
            uses = 0
            if row.switch_id is not None:
                if not self.names.containsKey((row.switch_id,)):
                    self.names.updateValue((row.switch_id,), (row.switch_name,))
                who = (row.switch_id, self.names.getValue((row.switch_id,))[0])
                if row.switch_id.startswith(DYNAMIC):
                    held = self.counts.getValue((row.switch_id,)) if self.counts.containsKey((row.switch_id,)) else (0,)
                    uses = int(held[0]) + 1
                    self.counts.updateValue((row.switch_id,), (uses,))
            mood = self.moods.getValue((who[0],))[0] if self.moods.containsKey((who[0],)) else fixed.DEFAULT_EMOTION
            new_mood = row.emotion_cue if row.emotion_cue is not None else mood
            self.moods.updateValue((who[0],), (new_mood,))
            told = [dict(user=u, assistant=a) for u, a in past]
            for i, name in enumerate(WORLD):
                value = getattr(row, f"cue_{name}")
                scene[i] = scene[i] if value is None else value
            past = [*past, (row.user, row.assistant)][-self.pairs :]
            out.append((row.conv_id, row.turn, row.user, row.assistant, *who, new_mood, *scene, uses, told))
            if len(out) == CHUNK:
                yield pd.DataFrame(out, columns=columns)
                out = []
        self.persona.update(who)
        self.world.update(tuple(scene))
        self.history.put(past)
        yield pd.DataFrame(out, columns=columns)

    def close(self) -> None:
        pass


def follow_sessions(
    turns: DataFrame,
    profiles: DataFrame,
    initial_id: str = fixed.DEFAULT_CHARACTER,
    initial_name: str | None = None,
    pairs: int = fixed.HISTORY_PAIRS,
) -> DataFrame:
    """State after every arriving turn, with the history before it; equal to the batch folds.

    ``uses`` counts the switch messages to the turn's dynamic persona, 0 on other turns.
    """
    _use_state_store(turns)
    known = valid_profiles(profiles).select(
        F.col("id").alias("__slug"), F.col("name").alias("__known")
    )
    heard = hear_personas(turns)
    asked = F.col("persona").isNotNull()
    # rows that name nobody are spread over keys that no profile has
    nobody = F.concat_ws(" ", F.lit(" "), "conv_id", "turn")
    found = heard.withColumn("__slug", F.coalesce(slug(F.col("persona.name")), nobody)).join(
        checked_broadcast(known), "__slug", "left"
    )
    switch = F.when(asked, F.when(F.col("__known").isNotNull(), F.col("__slug")).otherwise(
        F.concat(F.lit(DYNAMIC), F.col("__slug"))
    ))
    reply = F.coalesce("assistant", F.lit(""))
    cued = found.select(
        "conv_id", "turn", "user", reply.alias("assistant"),
        switch.alias("switch_id"),
        F.when(asked, F.coalesce(F.col("__known"), F.col("persona.name"))).alias("switch_name"),
        cues.emotion_cue(F.col("user"), reply).alias("emotion_cue"),
        *[c.alias(f"cue_{n}") for n, c in cues.world_cues(F.col("user"), reply).items()],
    )
    output = (
        "conv_id bigint, turn bigint, user string, assistant string, character_id string, character_name string, "
        "emotion string, " + ", ".join(f"{w} string" for w in WORLD)
        + ", uses bigint, history array<struct<user: string, assistant: string>>"
    )
    return cued.groupBy("conv_id").transformWithStateInPandas(
        statefulProcessor=FollowSession(initial_id, initial_name or initial_id, pairs),
        outputStructType=output,
        outputMode="Append",
        timeMode="None",
    )
