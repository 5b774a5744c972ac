"""Stateful streams: an online fit with signals, and capital reserved for open orders."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickspark.operators.arma import OnlineFit, decision, dominant_root, effective_size


def fitted(rows: DataFrame, key: str, order: str, p: int, half_life: float, ridge: float = 1e-6) -> DataFrame:
    """(key, order, y, guess, error, following, sigma, rho) of a stream of rows(key, order, y, starts), by key.

    Each key's fit is kept as state from batch to batch; rows are taken in order within a batch.
    """

    def run(group: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fit = pickle.loads(state.get[0]) if state.exists else OnlineFit(p, 0, half_life, ridge)
        own = pd.concat(list(parts)).sort_values(order)
        out = []
        for at, y, starts in own[[order, "y", "starts"]].itertuples(index=False):
            if starts:
                fit.restart()
            if (made := fit.add(y)) is not None:
                rho = dominant_root(fit.theta[:p].tolist()) if fit.theta is not None else 0.0
                out.append((group[0], at, y, *made, fit.next(), fit.variance**0.5, rho))
        state.update((pickle.dumps(fit),))
        yield pd.DataFrame(out, columns=[key, order, "y", "guess", "error", "following", "sigma", "rho"])

    types = dict(rows.dtypes)
    schema = f"{key} {types[key]}, {order} {types[order]}, y double, guess double, error double, following double, sigma double, rho double"
    return rows.groupBy(key).applyInPandasWithState(run, schema, "fit binary", "append", GroupStateTimeout.NoTimeout)


def signals(rows: DataFrame, key: str, order: str, p: int, short: float, medium: float, ridge: float = 1e-6) -> DataFrame:
    """(key, order, y, short, medium, sigma, side, size, hold_bars) of a stream of rows(key, order, y, starts), by key.

    Two fits of half-lives short and medium are kept as state; their predictions of the next return are decided on as in
    the batch (arma.decision), with the short fit's deviation and root. A row comes out once both fits predict.
    """

    def run(group: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fits = pickle.loads(state.get[0]) if state.exists else [OnlineFit(p, 0, h, ridge) for h in (short, medium)]
        own = pd.concat(list(parts)).sort_values(order)
        out = []
        for at, y, starts in own[[order, "y", "starts"]].itertuples(index=False):
            if starts:
                for fit in fits:
                    fit.restart()
            if None in [fit.add(y) for fit in fits] or any(fit.theta is None for fit in fits):
                continue
            roots = [dominant_root(fit.theta[:p].tolist()) for fit in fits]
            out.append((group[0], at, y, *(fit.next() for fit in fits), fits[0].variance**0.5, *roots))
        state.update((pickle.dumps(fits),))
        yield pd.DataFrame(out, columns=[key, order, "y", "short", "medium", "sigma", "rho_short", "rho_medium"])

    types = dict(rows.dtypes)
    schema = f"{key} {types[key]}, {order} {types[order]}, y double, short double, medium double, sigma double, rho_short double, rho_medium double"
    made = rows.groupBy(key).applyInPandasWithState(run, schema, "fits binary", "append", GroupStateTimeout.NoTimeout)
    n_short, n_medium = (F.lit(effective_size(h)) for h in (short, medium))
    c = F.col
    signal = decision(c("short"), c("medium"), c("sigma"), c("rho_short"), c("rho_medium"), n_short, n_medium, F.lit(1.0))
    return made.withColumn("signal", signal).select(key, order, "y", "short", "medium", "sigma", "signal.side", "signal.size", "signal.hold_bars")


def reserved(orders: DataFrame, key: str) -> DataFrame:
    """(key, order_id, open, reserved): capital reserved after each event of a stream of orders(key, order_id, cost, open, at).

    An open order reserves its cost once; one that is closed, or no longer listed as open, frees it.
    """

    def run(group: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: dict[int, float] = pickle.loads(state.get[0]) if state.exists else {}
        out = []
        for order_id, cost, is_open in pd.concat(list(parts)).sort_values("at")[["order_id", "cost", "open"]].itertuples(index=False):
            if is_open:
                held[int(order_id)] = float(cost)
            else:
                held.pop(int(order_id), None)
            out.append((group[0], int(order_id), bool(is_open), sum(held.values())))
        state.update((pickle.dumps(held),))
        yield pd.DataFrame(out, columns=[key, "order_id", "open", "reserved"])

    types = dict(orders.dtypes)
    return orders.groupBy(key).applyInPandasWithState(run, f"{key} {types[key]}, order_id long, open boolean, reserved double", "held binary", "append", GroupStateTimeout.NoTimeout)
