"""Chat-template rendering as column expressions.

A message is ``struct<role:string, content:string>``; a message list is an
array of those.  Rendering is a ``transform`` + ``array_join`` on the row, so it
stays inside whole-stage codegen and never leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prefline.config import (DEFAULT_EOS, GEMMA_ANSWER_END, GEMMA_ANSWER_START, MODEL_FAMILY_MARKERS,
                             TEMPLATE_MESSAGE_END, TEMPLATE_SEPARATOR)


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def message(role, content) -> Column:
    role_c = F.lit(role) if isinstance(role, str) and role in ("system", "user", "assistant") else _c(role)
    return F.struct(role_c.alias("role"), _c(content).alias("content"))


def render_piece(role, content) -> Column:
    """One message of the fallback template, without the closing eos."""
    return F.concat(_c(role), F.lit(TEMPLATE_SEPARATOR), _c(content), F.lit(TEMPLATE_MESSAGE_END))


def render(messages, eos: str = DEFAULT_EOS) -> Column:
    """The fallback chat template over a message array, ending with one eos."""
    pieces = F.transform(_c(messages), lambda m: render_piece(m["role"], m["content"]))
    return F.concat(F.array_join(pieces, ""), F.lit(eos))


def render_known(messages: list[tuple], eos: str = DEFAULT_EOS) -> Column:
    """T1 for a message list fixed at plan time, ``[(role, content), ...]`` with
    ``role`` a string and ``content`` a Column (or column name).

    The same string as ``render`` on the equivalent array, as one ``concat``:
    no array is built and no lambda runs, so it stays in whole-stage codegen.
    """
    parts = []
    for role, content in messages:
        parts += [F.lit(role), F.lit(TEMPLATE_SEPARATOR), _c(content), F.lit(TEMPLATE_MESSAGE_END)]
    return F.concat(*parts, F.lit(eos))


def user_prompt(query, system_text: str | None = None, eos: str = DEFAULT_EOS) -> Column:
    """T1 over [system?, user(query)] without building the message array."""
    msgs = ([("system", F.lit(system_text))] if system_text else []) + [("user", query)]
    return render_known(msgs, eos)


def with_system(messages, text: str, enabled: bool = True) -> Column:
    """Put a system message first when ``enabled``."""
    if not enabled:
        return _c(messages)
    return F.concat(F.array(message("system", F.lit(text))), _c(messages))


def user_messages(query, system_text: str | None = None) -> Column:
    """[system?, user(query)] as a message array."""
    msgs = F.array(message("user", query))
    return with_system(msgs, system_text) if system_text else msgs


def mistral_answer(text, eos: str = DEFAULT_EOS) -> Column:
    """The answer followed by eos."""
    return F.concat(_c(text), F.lit(eos))


def gemma_answer(text) -> Column:
    """T4: the answer inside the model turn markers."""
    return F.concat(F.lit(GEMMA_ANSWER_START), _c(text), F.lit(GEMMA_ANSWER_END))


def default_answer(text, eos: str = DEFAULT_EOS) -> Column:
    """T1 applied to [assistant(text)]."""
    return render_known([("assistant", text)], eos)


def model_family(model_name: str) -> str:
    """first match wins: mistral, then gemma, else the default template."""
    name = model_name.lower()
    for marker in MODEL_FAMILY_MARKERS:
        if marker in name:
            return marker
    return "default"


def answer(text, family: str, eos: str = DEFAULT_EOS) -> Column:
    if family == "mistral":
        return mistral_answer(text, eos)
    if family == "gemma":
        return gemma_answer(text)
    return default_answer(text, eos)
