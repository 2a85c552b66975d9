"""What a user configures: vocabularies, localities and scoring weights, as plain data.

Lists are small and known when a plan is built; they become literals in it.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# Defaults that decide results.
REMOTE_LOCATION_TOKENS = ("remote", "work from home", "work-from-home", "work from anywhere", "work-from-anywhere", "anywhere", "distributed", "telecommute", "home-based", "home based", "virtual", "wfh")
REMOTE_BODY_PHRASES = (
    "fully remote", "100% remote", "remote-first", "remote first", "remote-friendly", "remote friendly", "remote position", "remote role", "remote opportunity", "remote (us", "remote - us", "remote, us", "us-remote", "us remote", "remote within the us", "remote in the us", "work from home", "work-from-home",
    "work from anywhere", "work-from-anywhere", "from anywhere", "anywhere in the world", "anywhere in the u", "home-based", "home based", "telecommute", "distributed team", "distributed company", "distributed workforce", "fully distributed", "globally distributed", "remote/distributed",
    "remote or distributed", "this is a remote", "this role is remote", "position is remote",
)
REMOTE_NEGATIONS = (
    "not remote", "no remote", "non-remote", "not a remote", "not eligible for remote", "not available for remote", "no remote option", "remote is not", "remote work is not", "this role is not remote", "this position is not remote", "on-site only", "onsite only", "on site only", "fully on-site",
    "fully onsite", "in-office only", "in office only", "must be on-site", "must be onsite", "must be in office", "must be in-office", "must be located in", "relocation required", "relocation is required", "no relocation",
)
US_MARKERS = ("us", "u.s", "usa", "united states", "america", "americas", "north america", "worldwide", "global", "anywhere", "world")
NON_US_REGIONS = (
    "philippines", "india", "pakistan", "bangladesh", "nigeria", "kenya", "south africa", "europe", "emea", "apac", "asia", "africa", "latam", "latin america", "south america", "canada", "uk", "united kingdom", "ireland", "australia", "new zealand", "germany", "france", "spain", "poland", "portugal",
    "netherlands", "ukraine", "romania", "czech", "brazil", "argentina", "mexico", "colombia", "vietnam", "indonesia", "china", "japan", "singapore",
)
AXES = ("domain", "function", "stack", "seniority")
AXIS_WEIGHTS = {"domain": 0.25, "function": 0.34, "stack": 0.33, "seniority": 0.08}
GATE_PENALTIES = {"geo": 0.20, "embedded": 0.40, "level": 0.35, "phd": 0.45, "management": 0.35, "clearance": 0.45}
DISPOSITIONS = ("saved", "applied", "interviewing", "offer", "rejected", "dismissed")


@dataclass(frozen=True)
class Vocabulary:
    core: tuple[str, ...] = ()
    domain: tuple[str, ...] = ()
    skill: tuple[str, ...] = ()
    extra: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    exclude_title: tuple[str, ...] = ()
    boilerplate: tuple[str, ...] = ()

    def focused(self, **tiers: tuple[str, ...]) -> Vocabulary:
        """Tiers extended by new terms, each once whatever its case; an empty list changes nothing."""
        grown = {}
        for name, terms in tiers.items():
            kept = list(getattr(self, name))
            for term in terms:
                if term.lower() not in {x.lower() for x in kept}:
                    kept.append(term)
            grown[name] = tuple(kept)
        return replace(self, **grown)

    def only(self, **tiers: tuple[str, ...]) -> Vocabulary:
        """Tiers replaced, except by empty lists, which never blank one."""
        return replace(self, **{name: tuple(terms) for name, terms in tiers.items() if terms})


@dataclass(frozen=True)
class Excludes:
    """Terms that drop a posting of a track; matched in lower case."""

    role_phrases: tuple[str, ...] = ()
    title_tokens: tuple[str, ...] = ()
    strong: tuple[str, ...] = ()
    weak: tuple[str, ...] = ()
    nonclinical: tuple[str, ...] = ()
    radar_context: tuple[str, ...] = ("military", "defense", "defence", "weapon", "warfare", "missile", "rf ")


@dataclass(frozen=True)
class Profile:
    vocabulary: Vocabulary = field(default_factory=Vocabulary)
    excludes: Excludes = field(default_factory=Excludes)
    technical_title: str = r"engineer|scientist|developer"
    local_words: tuple[str, ...] = ()
    local_names: tuple[str, ...] = ()
    multi_division: tuple[str, ...] = ()
    mission_floor: float = 0.6
    weights: dict[str, float] = field(default_factory=lambda: dict(AXIS_WEIGHTS))
    penalties: dict[str, float] = field(default_factory=lambda: dict(GATE_PENALTIES))

    def with_fit(self, weights: dict[str, float] | None = None, penalties: dict[str, float] | None = None) -> Profile:
        """Both are merged over the defaults, so one that is left out keeps its effect."""
        return replace(self, weights={**self.weights, **(weights or {})}, penalties={**self.penalties, **(penalties or {})})


def validate(raw: dict) -> list[str]:
    """What is wrong with a profile read from TOML: missing sections, lists of other things than strings, weights outside 0 to 1."""
    errors = [f"missing section [{name}]" for name in ("keywords", "exclude", "locations", "fit") if not isinstance(raw.get(name), dict)]
    for section, values in raw.items():
        for key, value in values.items() if isinstance(values, dict) else ():
            if isinstance(value, list) and not (all(isinstance(x, str) for x in value) or all(isinstance(x, dict) for x in value)):
                errors.append(f"[{section}] {key} must hold strings")
    for name in ("weights", "gate_penalty"):
        table = raw.get("fit", {}).get(name, {}) if isinstance(raw.get("fit"), dict) else {}
        errors += [f"[fit] {name}.{key} must be from 0 to 1" for key, value in table.items() if not isinstance(value, (int, float)) or not 0 <= value <= 1]
    return errors
