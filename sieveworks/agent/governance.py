"""A simulation of the library's rules against a library without them; rates are assumed, arrivals seeded."""

from __future__ import annotations

import random
import tempfile

from .library import Library

# Hidden success rates of the kinds of skills; one kind rots halfway.
RATES = {"reliable": (0.95, 0.95), "mediocre": (0.60, 0.60), "rotted": (0.92, 0.20)}


def simulate(rounds: int = 200, skills: int = 80, seed: int = 0, uses: int = 5) -> dict:
    """Shares of uses by a bad skill, final sizes, and uses kept, with and without governance."""
    rng = random.Random(seed)
    with tempfile.TemporaryDirectory() as root:
        library, kinds = Library(root), {}
        bad = {"governed": 0, "ungoverned": 0}
        served = {"governed": 0, "ungoverned": 0}
        free: list[str] = []
        for r in range(rounds):
            if len(kinds) < skills:
                name = f"skill-{len(kinds)}"
                kinds[name] = rng.choice(list(RATES))
                library.register(name, 1)
                free.append(name)
            rate = lambda n: RATES[kinds[n]][r >= rounds // 2]  # noqa: E731,B023
            for _ in range(uses):
                live = [e["name"] for e in library.candidates(1)]
                for who, pool in (("governed", live), ("ungoverned", free)):
                    if not pool:
                        continue
                    name = rng.choice(pool[:10] if who == "governed" else pool)
                    ok = rng.random() < rate(name)
                    served[who] += 1
                    bad[who] += rate(name) < 0.5
                    if who == "governed":
                        library.record(name, success=ok, dataset=f"d{rng.randrange(20)}")
        live = len(library.candidates(1))
    return {"bad_share": {k: bad[k] / max(1, served[k]) for k in bad}, "size": {"governed": live, "ungoverned": len(free)}, "served": served}
