"""Windows of recorded sessions as chat messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions import messages as M
from tracemill.functions import scalars as S
from tracemill.operators import sequences

WINDOW = "workflow {key}, first_step long, end_step long, history long, omitted long, tokens long"
#: Tokens of a step's frame beside its texts, of a log line's end.
FRAME, LINE = 24, 1


def numbered(steps: DataFrame) -> DataFrame:
    """Steps (workflow, step from 0, intent, completion) with number, their tokens and those of their log line."""
    told = steps.withColumn("said", F.struct((F.col("step") + 1).alias("number"), "intent", "completion"))
    cost = S.text_tokens(M.step_text(F.col("said"))) + S.text_tokens(F.coalesce("completion", F.lit(""))) + FRAME
    return told.select("workflow", "step", "said", cost.alias("cost"), (S.text_tokens(M.log_line(F.col("said"))) + LINE).alias("log_cost"))


def windowed(steps: DataFrame, budget: int, header: int = 220, image: int = 0, min_steps: int = 1) -> DataFrame:
    """(workflow, first_step, end_step, omitted, tokens, steps, lines): consecutive steps that fit the budget, with the newest
    log lines before them that fit a fifth of it. Windows of fewer than `min_steps` are left out.

    Steps and windows meet on (workflow, step), so one long workflow is spread over its steps; a group is one window,
    and so bounded by the budget (or is one step). Rows without a workflow are left out.
    """
    s = numbered(steps)
    costs = s.select("workflow", "step", (F.col("cost") + image).alias("cost"), "log_cost")
    key = steps.schema["workflow"].dataType.simpleString()
    cut = sequences.fold(costs, ["workflow"], ["step"], lambda: sequences.Windows(budget, header=header), WINDOW.format(key=key))
    kept = cut.where(F.col("end_step") - F.col("first_step") >= min_steps)
    places = kept.withColumn("step", F.explode(F.sequence(F.col("first_step") - F.col("history"), F.col("end_step") - 1)))
    met = places.join(s.select("workflow", "step", "said"), ["workflow", "step"])
    lists = met.groupBy("workflow", "first_step", "end_step", "omitted", "tokens").agg(F.sort_array(F.collect_list(F.struct("step", "said"))).alias("all"))
    inside = F.filter("all", lambda x: x["step"] >= F.col("first_step"))["said"]
    lines = F.transform(F.filter("all", lambda x: x["step"] < F.col("first_step"))["said"], M.log_line)
    return lists.select("workflow", "first_step", "end_step", "omitted", "tokens", inside.alias("steps"), lines.alias("lines"))
