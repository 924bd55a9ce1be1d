"""Rule-based extraction of facts from reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verisheaf.functions import kernels as K
from verisheaf.functions import lexicon as L

_NO_BREAK = "[^\n。；]*"


def local_context(text: Column, start: Column, end: Column, radius: int = 14) -> Column:
    """EX1: the text between two places (from 0) and up to radius characters around, not beyond a line feed, full stop
    or semicolon."""
    first = F.greatest(start - radius, F.lit(0))
    left = F.regexp_extract(F.substr(text, first + 1, start - first), _NO_BREAK + r"\z", 0)
    right = F.regexp_extract(F.substr(text, end + 1, F.lit(radius)), "^" + _NO_BREAK, 0)
    return F.concat(left, F.substr(text, start + 1, end - start), right)


def entities(text: Column) -> Column:
    """EX2: array of (entity, status, severity, uncertain, term, context), one for each entity that occurs, by its longest
    term at its first place. In Arrow batches: a text is searched for some seventy terms, which costs a tenth of what
    folds over literals do."""
    return K.entities_of(text)


def facts(found: Column, text: Column, only: tuple[str, ...] | None = None) -> Column:
    """EX3, and EX6 with only: statuses of entities, and terms of the diagnosis. found: the result of entities."""
    kept = F.filter(found, lambda e: e["entity"].isin(*only)) if only else found
    stated = F.transform(kept, lambda e: F.concat(F.lit("entity:"), e["entity"], F.lit(":"), e["status"]))
    return F.array_union(stated, F.transform(K.terms_of(text), lambda t: F.concat(F.lit("diagnosis:"), t)))


def key_facts(found: Column, text: Column) -> Column:
    """EX6."""
    return facts(found, text, L.KEY_ENTITIES)


def entity_names(found: Column) -> Column:
    """EX4."""
    return F.transform(found, lambda e: e["entity"])


def relations(found: Column) -> Column:
    """EX5."""
    each = F.transform(
        found,
        lambda e: F.array_compact(
            F.array(
                F.concat(e["entity"], F.lit("|status="), e["status"]),
                F.concat(e["entity"], F.lit("|severity="), e["severity"]),
                F.when(e["uncertain"], F.concat(e["entity"], F.lit("|uncertain=true"))),
            )
        ),
    )
    return F.flatten(each)


def numeric_claims(text: Column) -> Column:
    """EX7: needs the places of matches, so it runs in Arrow batches."""
    return K.claims_of(text)


def compare_numbers(reference: Column, predicted: Column) -> Column:
    """MT17 over two texts, from EX7 of either, in one pass: claims don't leave the worker."""
    return K.numbers_of(reference, predicted)
