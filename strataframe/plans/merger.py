"""Merges of branches: a fast-forward moves the head, a three-way merge makes a commit of two parents or refuses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import algebra, history
from ..sources.store import Store
from .differ import record_key

#: Keys in conflict that a refusal names.
SHOWN = 20


def merge_into(store: Store, message: str, master: str, dev: str) -> str:
    """Merge dev into master; the head's new digest. RuntimeError with staged changes, ValueError on conflict or equal heads."""
    from .checkout import make_commit

    heads = store.heads()
    for name in (master, dev):
        if name not in heads:
            raise ValueError(f"no branch {name!r}")
    mine, theirs = heads[master], heads[dev]
    if store.files.exists("staging") and store.state().get("branch") is not None:
        at = heads[store.state()["branch"]]
        if not algebra.diff(store.refs(at), store.overlay(at)).isEmpty():
            raise RuntimeError("changes are staged; commit or reset them first")
    if mine == theirs:
        raise ValueError(f"{master!r} and {dev!r} have the same head")
    parents, times = store.parents(), store.times()
    if mine in history.ancestors(parents, theirs) or not mine:
        digest = theirs
    else:
        base = store.refs(history.common_ancestor(parents, times, mine, theirs) or "")
        sides = base, store.refs(mine), store.refs(theirs)
        with store.work(algebra.merged_rows(*sides)) as rows:
            layouts = [(r["col"],) for r in algebra.layout_conflicts(*sides).take(SHOWN)]
            clash = rows.where(F.col("conflict").isNotNull())
            shown = clash.orderBy(*algebra.KEYS).limit(SHOWN).collect()
            if shown or layouts:
                counts = {r["conflict"]: r["n"] for r in clash.groupBy("conflict").agg(F.count("*").alias("n")).collect()}
                named = [(r["conflict"], *record_key(r)) for r in shown] + [("layout", *c) for c in layouts]
                raise ValueError(f"{master!r} and {dev!r} are in conflict: {counts}, such as {named}")
            with store.work(rows.where(F.col("digest").isNotNull()).select(*algebra.KEYS, "digest")) as merged:
                digest = make_commit(store, merged, [mine, theirs], message)
    store.set_heads(heads | {master: digest})
    store.clear_staging()
    store.set_state(branch=master)
    return digest
