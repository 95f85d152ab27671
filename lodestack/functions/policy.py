
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .text import _c


def normalised_result(result: str | Column, fixed: str | Column | None = None) -> Column:
    """struct(result, status): from the type tag on it is ok, another tag is an error, else a fix decides or it is to retry.

    fixed is the answer to one request to mend the format; null means that none was made.
    """
    x = F.trim(_c(result))
    fix = F.lit(None).cast("string") if fixed is None else F.trim(_c(fixed))
    at = lambda s: F.instr(s, P.TYPE_TAG)
    of = lambda text, status: F.struct(text.alias("result"), F.lit(status).alias("status"))
    from_tag = lambda s: F.trim(F.substring(s, at(s), F.length(s)))
    return (
        F.when(x.isNull(), of(F.lit(P.INVALID_RESPONSE), "retry"))
        .when(at(x) > 0, of(from_tag(x), "ok"))
        .when(F.startswith(x, F.lit(P.RESULT_TAG)), of(x, "error"))
        .when(F.coalesce(at(fix), F.lit(0)) > 0, of(from_tag(fix), "ok"))
        .otherwise(of(F.lit(P.INVALID_RESPONSE), "retry"))
    )


def persisted(status: str | Column) -> Column:
    """A result that is to be retried is never kept."""
    return _c(status) != "retry"


def transport_class(message: str | Column) -> Column:
    """rate_limit, connection or api, by what the error says."""
    x = F.lower(_c(message))
    has = lambda *words: F.coalesce(sum((F.contains(x, F.lit(w)).cast("int") for w in words), F.lit(0)) > 0, F.lit(False))
    return F.when(has("429", "rate"), "rate_limit").when(has("connect", "timeout", "handshake", "timed out"), "connection").otherwise("api")


def backoff(kind: str | Column, attempt: str | Column) -> Column:
    """Seconds before the next try, attempts from 0."""
    power = F.pow(F.lit(2.0), _c(attempt))
    return F.when(_c(kind) == "rate_limit", F.least(power * 2, F.lit(60.0))).when(_c(kind) == "connection", F.least(power * 5, F.lit(60.0))).otherwise(2.0)


def throttle(step: str | Column, first: float = 3.0, most: float = 64.0) -> Column:
    """[R5] Seconds between two messages, doubling up to a limit."""
    return F.least(F.pow(F.lit(2.0), _c(step)) * first, F.lit(most))


def grown_window(requests: str | Column, start: int, cap: int) -> Column:
    """[W6] A window after requests for more lines, each cut to the cap; the sum isn't."""
    return F.aggregate(_c(requests), F.lit(start).cast("long"), lambda now, r: now + F.least(r, F.lit(cap)).cast("long"))


def tool_requests(arguments: str | Column) -> Column:
    """[E12] struct(more_above, more_below) of a tool call's JSON."""
    return F.from_json(_c(arguments), "more_above INT, more_below INT")


def content_text(content: str | Column) -> Column:
    """A message's content as text, of its JSON: a string is itself, null is empty, anything else stays JSON."""
    x = _c(content)
    inside = F.get_json_object(F.concat(F.lit('{"c":'), x, F.lit("}")), "$.c")
    return F.when(x.isNull() | (F.trim(x) == "null"), F.lit("")).when(F.startswith(F.ltrim(x), F.lit('"')), inside).otherwise(x)


def prompt(template: str | Column, calls: int, language: str | Column) -> Column:
    """The template with the number of calls and the language; Chinese where none is given, and short names of English as English."""
    said = F.coalesce(F.nullif(F.trim(_c(language)), F.lit("")), F.lit("Chinese"))
    lang = F.when(F.lower(said).isin("en", "english", "英文"), "English").otherwise(said)
    return F.replace(F.replace(_c(template), F.lit("{MAX_TOOL_CALLS}"), F.lit(str(calls))), F.lit("{OUTPUT_LANG}"), lang)


def emitted_polls(polls: str | Column, threshold: int, first: float = 3.0, most: float = 64.0) -> Column:
    """[W11, R4, R5] Places, from 1, of the polls(at, pages, state) that are shown, in an array ordered by time.

    Shown are the first, those whose pages grew by the threshold since the last shown, a final state, and any after
    an interval that doubles while nothing of note happens.
    """
    zero = F.struct(
        F.lit(0).alias("place"), F.lit(None).cast("long").alias("pages"), F.lit(0.0).alias("at"),
        F.lit(first).alias("wait"), F.array().cast("array<int>").alias("shown"),
    )

    def step(s: Column, p: Column) -> Column:
        note = s["pages"].isNull() | (p["pages"] - s["pages"] >= threshold) | p["state"].isin("done", "failed")
        due = ~note & (p["at"] - s["at"] >= s["wait"])
        show, place = note | due, s["place"] + 1
        return F.struct(
            place.alias("place"), F.when(show, p["pages"]).otherwise(s["pages"]).alias("pages"), F.when(show, p["at"]).otherwise(s["at"]).alias("at"),
            F.when(note, F.lit(first)).when(due, F.least(s["wait"] * 2, F.lit(most))).otherwise(s["wait"]).alias("wait"),
            F.when(show, F.concat(s["shown"], F.array(place))).otherwise(s["shown"]).alias("shown"),
        )

    return F.aggregate(_c(polls), zero, step)["shown"]


def resume_action(status: str | Column, has_output: str | Column, batch: str | Column, remote: str | Column) -> Column:
    """[R7, J7] skip, download, poll or submit, by the kept state and what the service says of the batch (null: not valid)."""
    open_ = _c(status).isin("running", "timeout") & (F.coalesce(_c(batch), F.lit("")) != "")
    return (
        F.when((_c(status) == "done") & _c(has_output), "skip")
        .when(open_ & (_c(remote) == "done"), "download")
        .when(open_ & _c(remote).isNotNull(), "poll")
        .when(open_, "resubmit")
        .otherwise("submit")
    )


def retried(outcomes: str | Column, rate_budget: int = 100, other_budget: int = 3) -> Column:
    """[R9] struct(attempts, waited, ok) of a call whose attempts end in outcomes: ok, rate_limit, connection or api.

    Rate limits and other errors have budgets of repeats of their own; the call ends with the first success or an error
    beyond its budget.
    """
    zero = F.struct(F.lit(0).alias("attempts"), F.lit(0.0).alias("waited"), F.lit(0).alias("rate"), F.lit(0).alias("other"), F.lit(False).alias("ok"), F.lit(False).alias("over"))

    def step(s: Column, o: Column) -> Column:
        rate = s["rate"] + (o == "rate_limit").cast("int")
        other = s["other"] + (~o.isin("ok", "rate_limit")).cast("int")
        over = (o == "ok") | (rate > rate_budget) | (other > other_budget)
        wait = F.when(over, 0.0).otherwise(backoff(o, F.when(o == "rate_limit", s["rate"]).otherwise(s["other"])))
        after = F.struct((s["attempts"] + 1).alias("attempts"), (s["waited"] + wait).alias("waited"), rate.alias("rate"), other.alias("other"), (o == "ok").alias("ok"), over.alias("over"))
        return F.when(s["over"], s).otherwise(after)

    return F.aggregate(_c(outcomes), zero, step, lambda s: F.struct(s["attempts"], s["waited"], s["ok"]))


def tool_rounds(rounds: str | Column, most: int = 3) -> Column:
    """[R8] struct(rounds, result) of recorded rounds(calls, text): tools may be called ``most`` times, then an answer is due.

    An answer ends the loop; without one after the last round the result is the sentinel of an empty response.
    """
    zero = F.struct(F.lit(0).alias("rounds"), F.lit(None).cast("string").alias("result"))

    def step(s: Column, r: Column) -> Column:
        answer = F.nullif(F.trim(F.coalesce(r["text"], F.lit(""))), F.lit(""))
        calls = (r["calls"] > 0) & (s["rounds"] < most)
        after = F.struct((s["rounds"] + 1).alias("rounds"), F.when(~calls, answer).alias("result"))
        return F.when(s["result"].isNotNull() | (s["rounds"] > most + 1), s).otherwise(after)

    return F.aggregate(_c(rounds), zero, step, lambda s: F.struct(s["rounds"], F.coalesce(s["result"], F.lit(P.EMPTY_RESPONSE)).alias("result")))
