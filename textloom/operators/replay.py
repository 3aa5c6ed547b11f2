"""Replaying a conversation's tool calls against state, and holding stored results against what comes out."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.canonical import canonical, dumps_canonical, loads_strict

#: Where the numbers of submitted jobs begin, and how many there are. Fixed values.
FIRST_JOB, JOBS = 4_000_000, 1_000_000


@dataclass
class JobTable:
    """The jobs of one conversation: submitted, held, released, cancelled and requeued, and nothing else happens to them."""

    states: dict[str, str] = field(default_factory=dict)

    #: action -> (states that it takes, state that it gives)
    MOVES = {"hold_job": (("PENDING",), "HELD"), "release_job": (("HELD",), "PENDING"), "cancel_job": (("PENDING", "HELD"), "CANCELLED"), "requeue_job": (("CANCELLED",), "PENDING")}

    def step(self, tool: str, arguments: dict) -> dict:
        """A call's result; an error is a ValueError, and changes nothing."""
        if tool == "submit_job":
            script = arguments.get("script")
            if not isinstance(script, str) or not script.lstrip().startswith("#!"):
                raise ValueError("a script that names no interpreter")
            number = FIRST_JOB + int(hashlib.sha256(script.encode()).hexdigest(), 16) % JOBS
            while str(number) in self.states:
                number += 1
            self.states[str(number)] = "PENDING"
            return {"submitted": True, "job_id": str(number)}
        job = arguments.get("job_id")
        if not isinstance(job, str) or not re.fullmatch(r"[0-9]+(?:_[0-9]+)?", job):
            raise ValueError("no job id")
        state = self.states.get(job)
        if tool == "job_status":
            return {"job_id": job, "found": False} if state is None else {"job_id": job, "state": state}
        if tool == "list_jobs":
            return {"jobs": [{"job_id": j, "state": s} for j, s in sorted(self.states.items())]}
        if tool not in self.MOVES:
            raise ValueError("unknown tool")
        takes, gives = self.MOVES[tool]
        if state in takes:
            self.states[job] = gives
        return {"job_id": job, "done": state in takes}


def replay_calls(calls: DataFrame, conv: list[str], order: list[str], key: list[str], tool: str = "tool", arguments: str = "arguments", stored: str = "stored", begin: Callable[[], JobTable] = JobTable) -> DataFrame:
    """(key columns, result, error, matches) of every call, replayed in order from begin()'s state for each conversation.

    arguments and stored are JSON texts; result is canonical JSON, null with an error.  matches: stored is the same
    value (null if nothing is stored).  A conversation's calls stream through a task in order; of them only its state
    is held, so a long conversation takes time but no memory.  Calls of equal order come by their key.
    """
    own = calls.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(conv)], *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], *[F.col(c).alias(f"k{i}") for i, c in enumerate(key)], F.col(tool).alias("tool"), F.col(arguments).alias("arguments"), F.col(stored).alias("stored"))
    convs, keys = [f"c{i}" for i in range(len(conv))], [f"k{i}" for i in range(len(key))]
    dealt = own.repartition(*convs).sortWithinPartitions(*convs, *[f"o{i}" for i in range(len(order))], *keys)
    kinds = ", ".join(f"{k} {own.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, begin()
        for pdf in batches:
            out = []
            for row in zip(*[pdf[c] for c in convs], pdf["tool"], pdf["arguments"], pdf["stored"], strict=True):
                *which, name, given, was = row
                which = tuple(None if pd.isna(x) else x for x in which)
                if which != current:
                    current, state = which, begin()
                out.append(outcome(state, name, given, was))
            yield pd.concat([pdf[keys].reset_index(drop=True), pd.DataFrame(out, columns=["result", "error", "matches"], dtype=object)], axis=1)

    done = dealt.mapInPandas(run, f"{kinds}, result string, error string, matches boolean")
    return done.select(*[F.col(k).alias(c) for k, c in zip(keys, key, strict=True)], "result", "error", "matches")


def outcome(state: JobTable, tool: str | None, arguments: str | None, stored: str | None) -> tuple[str | None, str | None, bool | None]:
    try:
        given = loads_strict(arguments or "")
        if not isinstance(given, dict):
            raise ValueError("arguments are no object")
        result, error = dumps_canonical(state.step(tool or "", given)), None
    except ValueError as e:
        result, error = None, "arguments are no JSON" if type(e) is not ValueError else str(e)
    return result, error, None if stored is None else result is not None and canonical(stored) == result


def conversation_errors(replayed: DataFrame, conv: Column) -> DataFrame:
    """(conv, n_calls, n_errors, n_differ) of replay_calls() rows that carry what `conv` is made of."""
    return replayed.groupBy(conv.alias("conv")).agg(F.count("*").alias("n_calls"), F.count("error").alias("n_errors"), F.count_if(~F.col("matches")).alias("n_differ"))
