"""The text-state fold over a page's drawing operators: runs with the state they are shown in."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

RUN = "stream long, ord int, text string, font string, size double, x double, y double, char_space double, word_space double, scale double, leading double, mode int"


def _product(a: list[float], b: list[float]) -> list[float]:
    return [a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5]]


def fold(tokens: pd.DataFrame) -> list[tuple]:
    """tokens(ord, op, args): q and Q stack the state; Td, TD, Tm and T* move the line; Tj, ', \" and TJ show a run."""
    identity = [1.0, 0.0, 0.0, 1.0, 0.0, 0.0]
    state = {"font": None, "size": 0.0, "Tc": 0.0, "Tw": 0.0, "Tz": 100.0, "TL": 0.0, "Tr": 0, "Ts": 0.0}
    stack, line, out = [], list(identity), []

    def move(x: float, y: float) -> None:
        nonlocal line
        line = _product([1.0, 0.0, 0.0, 1.0, x, y], line)

    for t in tokens.sort_values("ord").itertuples():
        a = list(t.args)
        if t.op == "q":
            stack.append((dict(state), list(line)))
        elif t.op == "Q" and stack:
            state, line = stack.pop()
        elif t.op == "BT":
            line = list(identity)
        elif t.op == "Tf":
            state["font"], state["size"] = a[0], float(a[1])
        elif t.op == "Tm":
            line = [float(x) for x in a]
        elif t.op in ("Td", "TD"):
            if t.op == "TD":
                state["TL"] = -float(a[1])
            move(float(a[0]), float(a[1]))
        elif t.op == "T*":
            move(0.0, -state["TL"])
        elif t.op in ("Tc", "Tw", "Tz", "TL", "Ts"):
            state[t.op] = float(a[0])
        elif t.op == "Tr":
            state["Tr"] = int(a[0])
        elif t.op in ("Tj", "TJ", "'", '"'):
            if t.op == '"':
                state["Tw"], state["Tc"] = float(a[0]), float(a[1])
            if t.op in "'\"":
                move(0.0, -state["TL"])
            text = "".join(x for x in a if not x.lstrip("-").replace(".", "", 1).isdigit()) if t.op == "TJ" else a[-1]
            out.append((t.stream, len(out) + 1, text, state["font"], state["size"], line[4], line[5] + state["Ts"], state["Tc"], state["Tw"], state["Tz"], state["TL"], state["Tr"]))
    return out


def text_runs(tokens: DataFrame) -> DataFrame:
    """tokens(stream, ord, op, args array<string>) -> the runs of each stream."""
    names = [x.split()[0] for x in RUN.split(", ")]
    return tokens.groupBy("stream").applyInPandas(lambda rows: pd.DataFrame(fold(rows), columns=names), RUN)
