"""Prompt texts as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stepwright.functions.text import rstrip

# The wording that downstream models and parsers expect.
STEP_BY_STEP = "\nAnswer step by step and end with '#### <answer>'."
PLACEHOLDER = "\nAnswer step by step."
NUMBERED_STEPS = "\nAnswer with 3 to 6 numbered steps. Make each step short and include any arithmetic explicitly. End with a final line in the form '#### <answer>'."
EVAL_SUFFIX = "\n\nSolve the problem. Show the calculation briefly and end with exactly one line: #### <answer>"
CONTINUE = "\nContinue the solution."
CONTINUE_API = "\n\nA partial solution is given below. Continue it naturally to the final answer. End with '#### <answer>'.\n\nPartial solution:\n"
CHOSEN = "Solve the problem correctly. End with the exact final answer marker.\n\nQuestion: "
REJECTED = (
    "Write a plausible step-by-step solution, but make exactly one arithmetic mistake in the middle so the final answer is wrong. "
    "Do not mention that it is intentionally wrong. End with '#### <wrong answer>'.\n\nQuestion: "
)
JUDGE = (
    "You are checking a rejected math solution against the gold answer.\n\nQuestion and instruction:\n",
    "\n\nGold solution / answer:\n",
    "\n\nRejected solution steps, indexed from 0:\n",
    "\n\nFind the first step where the rejected solution becomes mathematically or logically wrong.\n"
    "If all reasoning steps are correct but the solution is incomplete or missing the final answer, choose the final listed step.\n"
    "If a step is merely verbose but still correct, do not mark it wrong.\n\n"
    "Return only one JSON object with this exact schema:\n"
    '{"first_error_step": <integer index>, "confidence": <number from 0 to 1>, "rationale": "<short reason>"}\n',
)


def question(q: Column, ending: str = "") -> Column:
    return F.concat(F.lit("Question: "), q, F.lit(ending))


def eval_prompt(prompt: Column) -> Column:
    return F.when(F.contains(prompt, F.lit("####")), prompt).otherwise(F.concat(prompt, F.lit(EVAL_SUFFIX)))


def elicit_chosen(q: Column, answer: Column) -> Column:
    return F.concat(F.lit(CHOSEN), q, F.lit("\nGold final answer: "), answer)


def elicit_rejected(q: Column, answer: Column) -> Column:
    return F.concat(F.lit(REJECTED), q, F.lit("\nThe correct final answer is "), answer, F.lit(", but your final answer must be different."))


def prefix_text(steps: Column, k: Column) -> Column:
    return F.array_join(F.slice(steps, F.lit(1), k + 1), "\n")


def rollout_prompt(prompt: Column, steps: Column, k: Column) -> Column:
    return F.concat(rstrip(prompt), F.lit("\n"), rstrip(prefix_text(steps, k)), F.lit(CONTINUE))


def rollout_prompt_api(prompt: Column, steps: Column, k: Column) -> Column:
    return F.concat(prompt, F.lit(CONTINUE_API), prefix_text(steps, k))


def judge_prompt(prompt: Column, gold: Column, steps: Column) -> Column:
    listed = F.array_join(F.transform(steps, lambda s, i: F.concat(i.cast("string"), F.lit(". "), s)), "\n")
    a, b, c, d = map(F.lit, JUDGE)
    return F.concat(a, prompt, b, gold, c, listed, d)
