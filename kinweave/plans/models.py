"""Ready-made models: the rules, comparisons and training rules of each standard job."""

from __future__ import annotations

from dataclasses import dataclass

from ..operators.candidates import Rule
from ..operators.compare import exact_match, jaro_winkler_at, levenshtein_at, name_comparison
from ..operators.model import Model


@dataclass(frozen=True)
class JobModel:
    """A fresh model with the rules it is trained on and the threshold it clusters at."""

    model: Model
    training: tuple[Rule, ...] = ()
    threshold: float = 0.70
    prior_rules: tuple[Rule, ...] = ()


# Fixed values in this module: the fields, cuts, rules and thresholds of the standard models, which results depend on.

NAMES = ("given_name", "surname")

# rules that bring two person tables together, strictest first
SIX_RULES = (
    NAMES,
    ("date_of_birth",),
    ("soc_sec_id",),
    ("state", "address_1"),
    ("street_number", "address_1"),
    ("postcode",),
)


def febrl_dedupe() -> JobModel:
    comparisons = (
        name_comparison("given_name"),
        name_comparison("surname"),
        levenshtein_at("date_of_birth", [1, 2]),
        jaro_winkler_at("address_1", [0.9, 0.7]),
        jaro_winkler_at("address_2", [0.9, 0.7]),
        levenshtein_at("suburb", 2),
        levenshtein_at("state", 2),
        exact_match("street_number", tf=True),
        exact_match("postcode", tf=True),
    )
    rules = (("surname",), ("postcode",))
    return JobModel(Model(comparisons, rules), (NAMES, ("date_of_birth",)))


def _usa(link_type: str) -> JobModel:
    comparisons = (
        name_comparison("given_name"),
        name_comparison("surname"),
        levenshtein_at("birthdate", [1, 2]),
        jaro_winkler_at("address", [0.8, 0.75]),
        levenshtein_at("city", 2),
        levenshtein_at("state", 2),
        exact_match("zip", tf=True),
    )
    rules = (("given_name",), ("surname",))
    return JobModel(Model(comparisons, rules, link_type=link_type), (NAMES,))


def usa_dedupe() -> JobModel:
    return _usa("dedupe_only")


def usa_link() -> JobModel:
    return _usa("link_only")


def _febrl_link_comparisons():
    return (
        name_comparison("given_name", tf=True),
        name_comparison("surname", tf=True),
        levenshtein_at("date_of_birth", [1, 2]),
        levenshtein_at("soc_sec_id", [1, 2]),
        exact_match("street_number", tf=True),
        levenshtein_at("postcode", [1, 2], tf=True),
    )


def febrl_link() -> JobModel:
    rules = (NAMES, ("date_of_birth",), ("soc_sec_id",))
    model = Model(_febrl_link_comparisons(), rules, link_type="link_only")
    return JobModel(model, (("date_of_birth",), ("postcode",)))


def febrl_link_detailed() -> JobModel:
    model = Model(_febrl_link_comparisons(), SIX_RULES, link_type="link_only")
    prior = (("soc_sec_id",), ("given_name", "surname", "date_of_birth"))
    return JobModel(model, (("date_of_birth",), ("postcode",)), 0.99, prior)


def link_simple() -> JobModel:
    comparisons = tuple(exact_match(c, tf=True) for c in ("given_name", "surname", "street_number"))
    return JobModel(Model(comparisons, SIX_RULES, link_type="link_only"))


def usa_dedupe_notebook() -> JobModel:
    comparisons = (
        name_comparison("given_name"),
        name_comparison("surname"),
        levenshtein_at("birthdate", [1, 2]),
        jaro_winkler_at("address", [0.7, 0.5]),
        jaro_winkler_at("county", [0.7, 0.5]),
        levenshtein_at("city", 2),
        levenshtein_at("state", 2),
        exact_match("zip", tf=True),
    )
    rules = (("given_name",), ("surname",))
    return JobModel(Model(comparisons, rules), (NAMES, ("zip",)), 0.75)


JOBS = {
    ("febrl", "dedupe_only"): febrl_dedupe,
    ("usa", "dedupe_only"): usa_dedupe,
    ("febrl", "link_only"): febrl_link,
    ("usa", "link_only"): usa_link,
}
