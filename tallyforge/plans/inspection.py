"""What Spark makes of a query before it runs: its analyzed operators and the bytes that its pruned scans read.

Patterns on the text of a query can be got round; the analyzed plan cannot. Both are read from the driver's plan objects,
nothing is executed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Operators that choose, order and cut rows of one relation.
PLAIN = ("GlobalLimit", "LocalLimit", "Sort", "Project", "Filter", "SubqueryAlias")
#: Leaves of a physical plan whose rows are in memory or made up: nothing stored is read.
STORED_NOWHERE = ("LocalTableScanExec", "RDDScanExec", "RangeExec", "OneRowRelationExec", "InMemoryTableScanExec", "EmptyRelationExec")


class Refused(ValueError):
    pass


def _name(node) -> str:
    return node.getClass().getSimpleName()


def _all(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _conjuncts(condition) -> list:
    if _name(condition) == "And":
        return _conjuncts(condition.left()) + _conjuncts(condition.right())
    return [condition]


def _owns(condition, column: str, value: str) -> bool:
    """Whether a condition is column = value: a bare column of the relation and a bare value."""
    if _name(condition) != "EqualTo":
        return False
    sides = {_name(x): x for x in (condition.left(), condition.right())}
    if sides.keys() != {"AttributeReference", "Literal"}:
        return False
    held = sides["Literal"].value()
    return sides["AttributeReference"].name() == column and held is not None and str(held) == value


def check_shape(out: DataFrame, owner: str, value: str, most: int) -> None:
    """One relation of the owner's rows, cut to `most`: a limit over plain operators down to a single view, and
    `owner = value` among the conditions that all rows have to meet."""
    node = out._jdf.queryExecution().analyzed()
    if _name(node) != "GlobalLimit" or _name(node.limitExpr()) != "Literal" or not 1 <= int(str(node.limitExpr().value())) <= most:
        raise Refused("the plan does not end in a limit of at most max_rows")
    owned = False
    while _name(node) in PLAIN:
        if node.subqueries().size():
            raise Refused("the plan has a subquery")
        if _name(node) == "Filter":
            owned = owned or any(_owns(c, owner, value) for c in _conjuncts(node.condition()))
        if not node.deterministic():
            raise Refused("the plan is not deterministic")
        node = node.children().apply(0)
    if _name(node) != "View" or not node.desc().identifier().table().startswith("_pyspark_"):
        raise Refused(f"the plan has an operator that is not allowed: {node.nodeName()}")
    if not owned:
        raise Refused(f"no condition of the plan binds {owner} to the session's value")


def scan_bytes(out: DataFrame) -> int | None:
    """Bytes of the files that the query reads, after partitions are pruned; None where a source does not say."""
    execution = out._jdf.queryExecution()
    if execution.optimizedPlan().subqueriesAll().size():
        return None
    total = 0
    for leaf in _all(execution.sparkPlan().collectLeaves()):
        kind = _name(leaf)
        if kind == "FileSourceScanExec":
            total += leaf.selectedPartitions().totalFileSize()
        elif kind == "BatchScanExec" and hasattr(leaf.scan(), "estimateStatistics"):
            size = leaf.scan().estimateStatistics().sizeInBytes()
            unknown = out._jdf.sparkSession().sessionState().conf().defaultSizeInBytes()
            if not size.isPresent() or size.getAsLong() >= unknown:
                return None
            total += size.getAsLong()
        elif kind not in STORED_NOWHERE:
            return None
    return total
