"""Row pattern windows: x OVER w with WINDOW w AS ( ... SEEK PATTERN ... ).

For each row, the first match that starts at or after it in its partition: the
clause runs once with SKIP TO NEXT ROW, and the kernel hands each row the next
match, so the input is read, dealt and sorted once.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ast import Call, Col, Query, QueryError
from ..plans.planner import Planner, fold


def window_query(query: Query, df: DataFrame, standard_semantics: bool = False) -> DataFrame:
    if len(query.windows) != 1:
        raise QueryError("one row pattern window is supported")
    if query.where is not None:
        raise QueryError("WHERE and a row pattern window don't go together; filter the DataFrame")
    clause = dataclasses.replace(next(iter(query.windows.values())), rows="SEEK", skip=("NEXT", None))
    names = [n for _, n in clause.measures]
    wanted = [name for e, _ in query.items if isinstance(e, Col) and (name := fold(e.name, df.columns))]
    done = Planner(clause, df, standard_semantics).build(list(dict.fromkeys(wanted)))
    out = []
    for e, alias in query.items:
        if isinstance(e, Call) and e.name == "OVER":
            name = fold(e.args[0].name, names) if isinstance(e.args[0], Col) else None
            if name is None:
                raise QueryError("OVER takes a measure of the window")
            out.append(F.col(f"`m_{name}`").alias(alias or name))
        elif isinstance(e, Col) and (name := fold(e.name, df.columns)):
            out.append(F.col(f"`{name}`").alias(alias or e.name))
        else:
            raise QueryError("SELECT takes columns, and measures OVER the window")
    from ..api import _finished

    return _finished(done.select(*out), query)
