"""Scores of symbols."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that begin a flow, and names of helpers.
ENTRY = r"^(?i:main|init|bootstrap|start|run|setup|configure)$|^(handle|on|process|execute|perform|dispatch|trigger|fire|emit)[A-Z]|Handler$|Controller$"
UTILITY = (
    r"^(get|set|is|has|can|should|will|did)[A-Z]|^_|^(?i:format|parse|validate|convert|transform)|^(?i:log|debug|error|warn|info)$|^(to|from)[A-Z]|"
    r"^(?i:encode|decode|serialize|deserialize|clone|copy|deep|merge|extend|assign|filter|map|reduce|sort|find)|Helper$|Utils?$|^(?i:utils?|helpers?)$"
)


def entry_point(name: Column, exported: Column, callers: Column, callees: Column, framework: Column | None = None) -> Column:
    """Calls made over calls received, doubled for exported symbols, times 0.3 for helpers or 1.5 for entry names; 0 without calls."""
    n = F.coalesce(name, F.lit(""))
    by_name = F.when(n.rlike(UTILITY), 0.3).when(n.rlike(ENTRY), 1.5).otherwise(1.0)
    score = callees / (callers + 1) * F.when(F.coalesce(exported, F.lit(False)), 2.0).otherwise(1.0) * by_name
    if framework is not None:
        score = score * F.coalesce(framework, F.lit(1.0))
    return F.when(callees == 0, F.lit(0.0)).otherwise(score)
