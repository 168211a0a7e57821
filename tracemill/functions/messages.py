"""Prompts, chat messages and their markup, training labels of token ids, as Column expressions.

A message is a struct of role and content; content is an array of parts (type, text), plain text being one part. A part
of type image has no text. Steps are structs of number, intent and completion; a task is a struct of application, task,
description and requirements (an array of texts). Missing and empty fields are the same.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lines of prompts that a trained model expects.
APPLICATION, TASK, DESCRIPTION, REQUIREMENTS, INTENT = "Application: ", "Task: ", "Description: ", "Requirements:", "Current intent: "
ASK, ASK_VERIFIED = "Return the next action(s) for the current screenshot as JSON.", "Given the current screenshot, return the next verified GUI actions."
EARLIER, NOTHING_EARLIER, OMITTED = "Earlier steps:", "Earlier steps: (none)", "({} earlier steps omitted)"

#: Markup of the chat format.
START, END, THINK, IMAGE = "<|im_start|>", "<|im_end|>", "<think>\n\n</think>\n\n", "<|vision_start|><|image_pad|><|vision_end|>"
#: Fixed value: the label of a token that is not trained on.
IGNORED = -100

PART = "struct<type:string,text:string>"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(trimmed_right(text), r"(?U)^[\s\x1c-\x1f]+", "")


def trimmed_right(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+$", "")


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _line(label: str, value: Column) -> Column:
    """A labelled line, null (and so left out) for a missing value."""
    return F.concat(F.lit(label), F.nullif(value, F.lit("")))


def _listed(requirements: Column) -> Column:
    return F.transform(requirements, lambda r: F.concat(F.lit("- "), _text(r)))


def task_header(task: Column, requirements: bool = True, description: bool = True) -> Column:
    """Lines of a task: its application, then whatever it has of task, description and requirements."""
    lines = [F.concat(F.lit(APPLICATION), _text(task["application"])), _line(TASK, task["task"])]
    if description:
        lines.append(_line(DESCRIPTION, task["description"]))
    if requirements:
        some = F.size(task["requirements"]) > 0
        lines.append(F.when(some, F.concat_ws("\n", F.lit(REQUIREMENTS), _listed(task["requirements"]))))
    return F.concat_ws("\n", *lines)


def prompt(task: Column, intent: Column, requirements: bool = True, description: bool = True) -> Column:
    """What a model is asked for one screenshot: the task's header, the intent, the request."""
    now = trimmed_right(F.concat(F.lit(INTENT), _text(intent)))
    return F.concat_ws("\n", task_header(task, requirements, description), now, F.lit(ASK))


def full_prompt(task: Column, intent: Column, action: Column) -> Column:
    """Every line of a task whether it has a value or not; the action stands for a missing intent."""
    parts = [(APPLICATION, task["application"]), (TASK, task["task"]), (DESCRIPTION, task["description"])]
    lines = [F.concat(F.lit(label), _text(value)) for label, value in parts]
    listed = F.array_join(F.coalesce(_listed(task["requirements"]), F.array().cast("array<string>")), "\n")
    wanted = F.coalesce(F.nullif(intent, F.lit("")), action, F.lit(""))
    return F.concat_ws("\n", *lines, F.lit(REQUIREMENTS), listed, F.concat(F.lit(INTENT), wanted), F.lit(ASK_VERIFIED))


def answer(summary: Column, actions: Column) -> Column:
    """Compact JSON of a summary and actions, nulls written out."""
    return F.to_json(F.struct(summary.alias("summary"), actions.alias("actions")), {"ignoreNullFields": "false"})


def part(text: Column) -> Column:
    return F.struct(F.lit("text").alias("type"), text.alias("text"))


def message(role: str, text: Column, image: bool = False) -> Column:
    picture = [F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"))] if image else []
    return F.struct(F.lit(role).alias("role"), F.array(*picture, part(text)).cast(f"array<{PART}>").alias("content"))


def prompt_messages(system: str, task: Column, intent: Column, requirements: bool = True, description: bool = True) -> Column:
    """System message and one question with its screenshot."""
    return F.array(message("system", F.lit(system)), message("user", prompt(task, intent, requirements, description), image=True))


def log_line(step: Column) -> Column:
    """A past step as one line of a log."""
    return F.concat(step["number"].cast("string"), F.lit(". "), _text(step["intent"]), F.lit(" -> "), _text(step["completion"]))


def step_text(step: Column) -> Column:
    """A step's question within a session."""
    return F.concat(F.lit("Step "), step["number"].cast("string"), F.lit("\n" + INTENT), _text(step["intent"]), F.lit("\n" + ASK))


def session_messages(system: str, task: Column, steps: Column, lines: Column, omitted: Column, requirements: bool = True, description: bool = True) -> Column:
    """A window of a session as alternating questions and answers; the first question tells the task and the log before it."""
    told = F.concat(
        F.array(F.lit(EARLIER)),
        F.when(omitted > 0, F.array(F.replace(F.lit(OMITTED), F.lit("{}"), omitted.cast("string")))).otherwise(F.array().cast("array<string>")),
        lines,
    )
    before = F.when((omitted > 0) | (F.size(lines) > 0), F.array_join(told, "\n")).otherwise(NOTHING_EARLIER)
    opening = F.concat(task_header(task, requirements, description), F.lit("\n\n"), before, F.lit("\n\n"))

    def asked(step: Column, i: Column) -> Column:
        question = F.concat(F.when(i == 0, opening).otherwise(""), step_text(step))
        return F.array(message("user", question, image=True), message("assistant", _text(step["completion"])))

    return F.concat(F.array(message("system", F.lit(system))), F.flatten(F.transform(steps, asked)))


def rendered(messages: Column, think: bool = True, answered: bool = True) -> Column:
    """Messages in chat markup; the last answer opens with an empty thought if `think`.

    Not `answered`: the text up to where the last answer would begin, which is what a model continues. Roles other than
    system, user and assistant are an error.
    """
    roles = messages["role"]
    last = F.when(F.array_contains(roles, "assistant"), F.size(roles) - F.array_position(F.reverse(roles), F.lit("assistant"))).otherwise(-1)
    known = roles_known(roles)

    def said(m: Column, i: Column) -> Column:
        pieces = F.transform(m["content"], lambda p: F.when(p["type"] == "image", IMAGE).otherwise(_text(p["text"])))
        thought = F.when(i == last, THINK).otherwise("") if think else F.lit("")
        return F.concat(F.lit(START), m["role"], F.lit("\n"), thought, trimmed(F.array_join(pieces, "")), F.lit(END))

    if answered:
        text = F.array_join(F.transform(messages, said), "\n")
    else:
        kept = F.when(last >= 0, F.slice(messages, 1, last.cast("int"))).otherwise(messages)
        lines = F.array_join(F.transform(F.transform(kept, said), lambda s: F.concat(s, F.lit("\n"))), "")
        text = F.concat(lines, F.when(last >= 0, F.lit(f"{START}assistant\n{THINK}")).otherwise(""))
    return F.when(known, text).otherwise(F.raise_error(F.lit("unexpected role")))


def roles_known(roles: Column) -> Column:
    return F.forall(roles, lambda r: F.coalesce(r.isin("system", "user", "assistant"), F.lit(False)))


def labels(ids: Column, header: list[int], think: list[int], end: int) -> Column:
    """Token ids with all but the answers masked: what follows a header (and an empty thought) up to `end`, that included.

    Between one `end` and the next the first header counts; an answer without an end isn't trained on. Linear in the
    ids: they are written as <1><2>.., cut at the end token and masked by text functions.
    """
    coded = lambda tokens: "".join(f"<{t}>" for t in tokens)
    opening, thought, close = coded(header), coded(think), f"<{end}>"
    segments = F.split(F.array_join(F.transform(ids, lambda i: F.concat(F.lit("<"), i.cast("string"), F.lit(">"))), ""), close, -1)
    masked = lambda s: F.regexp_replace(s, "<[0-9]+>", f"<{IGNORED}>")

    def labelled(s: Column, i: Column) -> Column:
        closed = i < F.size(segments) - 1
        at = F.instr(s, opening)
        rest = F.substr(s, at + len(opening))
        kept = F.when(rest.startswith(thought), F.substr(rest, F.lit(len(thought) + 1))).otherwise(rest) if think else rest
        before = F.left(s, F.char_length(s) - F.char_length(kept))
        return F.when(closed & (at > 0), F.concat(masked(before), kept, F.lit(close))).otherwise(F.concat(masked(s), F.when(closed, f"<{IGNORED}>").otherwise("")))

    return F.transform(F.regexp_extract_all(F.array_join(F.transform(segments, labelled), ""), F.lit("-?[0-9]+"), F.lit(0)), lambda t: t.cast("int"))
