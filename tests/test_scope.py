"""Scope match of 5,000 cards against a plain loop, with and without a broadcast."""

import random

import pytest

from corvida.operators import bank


@pytest.mark.parametrize("limit", [16 << 20, 0])
def test_five_thousand_cards(spark, limit):
    rng = random.Random(17)
    tags, atoms = [f"t{i}" for i in range(12)], ["C", "H", "O", "N", "S", "F"]
    some = lambda pool, k: rng.sample(pool, rng.randint(0, k))
    cards = [(f"m{i}", i % 11 > 0, some(tags, 2), some(tags, 2), some(atoms, 4), rng.choice([None, 3]), rng.choice([None, 9]), some(tags, 3)) for i in range(5000)]
    cards += [("nulls", None, None, None, None, None, None, None), ("open", True, None, None, None, None, None, None)]
    rows = [(i, some(tags, 5), some(atoms, 4), rng.choice([None, 1, 5, 12]), i % 5 > 0) for i in range(20)] + [(20, None, None, None, True), (21, [], [], 4, None)]
    got = bank.scope_match(spark.createDataFrame(rows, "id long, tags array<string>, atoms array<string>, carbon_count int, valid boolean"), spark.createDataFrame(
        cards, "model_id string, has_scope boolean, excluded_tags array<string>, required_tags array<string>, allowed_atoms array<string>, carbon_min int, carbon_max int, allowed_tags array<string>"),
        "id", broadcast_bytes=limit).collect()
    assert len(got) == len(cards) * len(rows)
    want = {}
    for i, t, a, c, valid in rows:
        t, a = set(t or []), set(a or [])
        for m, scope, ex, req, al, lo, hi, ok in cards:
            hit, miss, extra = sorted(t & set(ex or [])), sorted(set(req or []) - t), sorted(a - set(al) - {"H"}) if al else []
            soft = [w for w, on in (("carbon below range", c is not None and lo is not None and c < lo), ("carbon above range", c is not None and hi is not None and c > hi), ("no allowed class", bool(ok) and not t & set(ok))) if on]
            why = [f"{n}: {', '.join(x)}" for n, x in (("excluded", hit), ("missing", miss), ("atoms", extra)) if x] + soft
            if not valid:
                want[i, m] = ("not_suitable", "invalid structure")
            elif not scope:
                want[i, m] = ("undefined", "no scope")
            else:
                want[i, m] = ("not_suitable" if hit or miss or extra else "partial" if soft else "suitable", "; ".join(why) or "scope matches")
    assert {(r["id"], r["model_id"]): (r["applicability"], r["reasons"]) for r in got} == want
