"""The checks by number: each takes the shared measures and the columns in scope, and gives findings."""

from __future__ import annotations

from collections.abc import Callable

from ..findings import Finding
from ..plans.measures import Measures

Check = Callable[[Measures, list[int]], list[Finding]]
CHECKS: dict[int, Check] = {}
#: Checks whose outcome for a column depends on that column alone.
BY_COLUMN = {1, 2, 3, 4, 5, 6, 7, 8, 13, 15, 17, 19, 21, 22}


def check(disease: int):
    def put(f: Check) -> Check:
        CHECKS[disease] = f
        return f

    return put
