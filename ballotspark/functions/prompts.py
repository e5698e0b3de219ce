"""Message columns for generation and scoring. Three templates for generation are given; others are the caller's."""

from pyspark.sql import Column
from pyspark.sql import functions as F


#: The system message, and the templates by name; {q} is the problem.
SYSTEM = "You are a careful mathematician. You always finish with a final integer answer."
TEMPLATES = {
    "A": "{q}",
    "B": "Solve the following math problem step by step. Put your final answer in \\boxed{}.\n\n{q}",
    "C": "Solve the following math problem step by step. The answer is a single integer. Put your final answer in \\boxed{}.\n\n{q}",
}


def filled(template: str, **columns: Column) -> Column:
    """A template with {name} replaced by columns; null counts as empty."""
    out = F.lit(template)
    for name, column in columns.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(column.cast("string"), F.lit("")))
    return out


def messages(user: Column, system: Column | None = None) -> Column:
    """array(struct(role, content)), with a system message if there is one."""
    one = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(one("user", user)) if system is None else F.array(one("system", system), one("user", user))


def shown_answer(key: Column, most: int = 20) -> Column:
    """A candidate answer for a prompt: a placeholder for none, the number of digits for very long ones."""
    return F.when(key.isNull(), "(none)").when(F.length(key) > most, F.concat(F.lit("("), F.length(F.replace(key, F.lit("-"), F.lit(""))).cast("string"), F.lit(" digits)"))).otherwise(key)


def within_budget(tokens: Column, budget: int, score: Column, floor: float = -20.0) -> Column:
    """The score, or the floor for prompts that are too long to be scored."""
    return F.when(tokens <= budget, score).otherwise(F.lit(floor))


def generation_messages(question: Column, template: str = "C", system: bool = True) -> Column:
    """Messages that ask for a solution, by one of TEMPLATES."""
    return messages(filled(TEMPLATES[template], q=question), F.lit(SYSTEM) if system else None)
