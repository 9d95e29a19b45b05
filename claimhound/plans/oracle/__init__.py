"""DuckDB SQL for each analysis, to check the DataFrame results against."""

from __future__ import annotations

from claimhound.plans.oracle import core, more, networks
from claimhound.plans.oracle.base import statement


def oracle_sql() -> dict[str, str]:
    bodies = {**core.STATEMENTS, **more.STATEMENTS, **networks.STATEMENTS}
    return {name: statement(body) for name, body in sorted(bodies.items())}
