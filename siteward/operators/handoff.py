"""What one stage hands on to the next, as contracts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql.types import StructType

from siteward.sources.contracts import Contract


def shape(must: dict[str, str], may: dict[str, str] | None = None) -> StructType:
    out = StructType()
    for names, nullable in ((must, False), (may or {}, True)):
        for name, kind in names.items():
            out.add(name, kind, nullable)
    return out


# Names of releases, seasons and later stages' columns.
ABSTAINS = "NO_STRONG_PREFERENCE"
SEASONS = ("spring", "summer", "autumn", "winter")
DATES = ("exact_month", "exact_date", "recommended_month", "recommended_date")


def season_rules(actionable: Sequence[str], columns: Sequence[str] = (), abstain: bool = False) -> dict[str, str]:
    """Rules of released seasons: known words; a row without a preference names no season, any other names two that differ;
    no column (of ``columns``, those of the table) holds a month or a day.  ``abstain``: the official release names no season at
    all, so that every row abstains with low confidence."""
    blank = lambda c: f"coalesce(trim({c}), '') = ''"
    release, season = "upper(trim(release))", lambda c: f"lower(trim({c}))"
    names, words = ", ".join(f"'{w}'" for w in (ABSTAINS, *actionable)), ", ".join(f"'{s}'" for s in SEASONS)
    free = f"{release} = '{ABSTAINS}'"
    rules = {
        "release is unknown": f"{release} IN ({names})",
        "confidence is blank": f"NOT {blank('confidence')}",
        "abstaining row names a season": f"NOT {free} OR ({blank('recommended')} AND {blank('fallback')})",
        "season is unknown": f"{free} OR ({season('recommended')} IN ({words}) AND {season('fallback')} IN ({words}))",
        "fallback repeats the season": f"{free} OR {season('recommended')} <> {season('fallback')}",
    }
    if abstain:
        rules |= {"row does not abstain": free, "confidence is not low": "upper(trim(confidence)) = 'LOW'"}
    return rules | {f"{c} is told too early": f"{c} IS NULL" for c in DATES if c in columns}


EXPOSURE_RULES = {
    "exposure is negative": "least(raw, own, crossing, far) >= 0",
    "own exceeds raw": "own <= raw + 1e-9",
    "crossing exceeds raw": "crossing <= raw + 1e-9",
    "far exceeds crossing": "far <= crossing + 1e-9",
    "parts don't add up": "abs(own + crossing - raw) <= 1e-8 + 1e-9 * abs(raw)",
}


def gap_contract(units: int | None = None, bundles: int | None = None) -> Contract:
    """Stage 2 to 3: need and ranked gap of every (unit, bundle), all of them if their numbers are given."""
    columns = shape({"unit": "long", "bundle": "string", "need": "double", "gap": "double", "place": "long"})
    rules = {"need is outside 0 to 100": "need BETWEEN 0 AND 100", "gap is outside 0 to 100": "gap BETWEEN 0 AND 100", "place is not positive": "place >= 1"}
    return Contract("gap_handoff", columns, ("unit", "bundle"), rules, ("site", *DATES), rows=units * bundles if units and bundles else None)


def site_contract(actionable: Sequence[str], columns: Sequence[str] = (), abstain: bool = False) -> Contract:
    """Stage 3 to 4: exposure, place and season of every (site, bundle); nothing of a later stage."""
    numbers = dict.fromkeys(("raw", "own", "crossing", "far"), "double")
    must = {"site": "long", "bundle": "string", "unit": "long", "region": "long", **numbers, "place": "long", "release": "string", "confidence": "string"}
    rules = EXPOSURE_RULES | {"place is not positive": "place >= 1", "spare is the site itself": "spare IS NULL OR spare <> site"} | season_rules(actionable, columns, abstain)
    return Contract("site_handoff", shape(must, {"spare": "long", "recommended": "string", "fallback": "string"}), ("site", "bundle"), rules, ("selected", "plan", "team", "vehicle", "schedule"), extra=True)
