"""Settings and rule phrases of the jobs; one frozen object goes to a job, executors never read the environment."""

from __future__ import annotations

from dataclasses import dataclass, field

#: The caption styles, in order.
STYLES = ("formal", "sarcastic", "humorous_tech", "humorous_non_tech")


@dataclass(frozen=True)
class RuleBook:
    """Phrases of the text rules, lower case.

    What isn't marked as fixed is a small starting list written for this library. A deployment gives its own phrases, as a table read by
    `sources.tables.read_rules` or by naming the fields here.
    """

    drafting_prefixes: tuple[str, ...] = ("outline:", "scratch:", "working title", "version a", "brainstorm:", "thinking aloud")
    drafting_markers: tuple[str, ...] = ("trim this down", "over the limit", "swap this word", "polish later", "tone check", "alternative wording")
    # Labels of a formatted description.
    field_labels: tuple[str, ...] = (
        "background:", "notable moments:", "actions (early):", "actions (late):", "primary subject:", "subject 1:", "subject 2:",
        "setting:", "camera:", "caption focus:", "on-screen text:",
    )
    leak_prefixes: tuple[str, ...] = ("as requested", "my instructions", "per the prompt", "sure thing", "below is")
    leak_markers: tuple[str, ...] = ("my instructions", "per the prompt", "the requested tone", "the supplied facts", "system message")
    score_leak_markers: tuple[str, ...] = ("my instructions", "per the prompt", "the requested tone")
    score_leak_prefixes: tuple[str, ...] = ("my instructions", "per the prompt")
    neutral_prefixes: tuple[str, ...] = ("footage of", "a recording of", "this clip depicts", "pictured here")
    checklist_tags: tuple[str, ...] = ("[who]", "[where]", "[doing]", "[mood]")
    evaluative_tails: tuple[str, ...] = ("nailed it", "fine by me", "not bad", "perfect")
    fragment_tails: tuple[str, ...] = ("the", "with", "into", "because", "than", "toward", "beside", "onto")
    fragment_sentences: tuple[str, ...] = ("perhaps", "anyway", "next", "still", "alright")
    dangling_endings: tuple[str, ...] = ("as if a", "because of the", "such as", "in front of the")
    cut_stems: tuple[str, ...] = ("backgr", "recordi", "somethi", "peopl", "stand-u")
    label_prefixes: tuple[str, ...] = ("result:", "title:", "my line:", "rewritten:")
    entities: tuple[str, ...] = ("calf", "cow", "fox", "goat", "goose", "hen", "lamb", "monkey", "parrot", "rooster", "sheep", "squirrel", "turtle", "wolf")
    synonyms: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"hen": ("chicken", "rooster"), "rooster": ("chicken", "hen"), "lamb": ("sheep",), "sheep": ("lamb",), "calf": ("cow",), "cow": ("calf",)})
    content_stopwords: tuple[str, ...] = ("the", "and", "but", "her", "his", "one", "than", "then", "there", "they", "was", "who", "with", "you")
    grounding_stopwords: tuple[str, ...] = ("the", "and", "near", "past", "some", "very", "with", "shown", "shot", "frame", "view")
    action_verbs: tuple[str, ...] = ("carries", "climbs", "crosses", "drifts", "drops", "eats", "falls", "holds", "lifts", "opens", "pulls", "pushes", "rides", "rolls", "sings", "sleeps", "throws", "waves")
    tech_words: tuple[str, ...] = ("algorithm", "backup", "bandwidth", "compiler", "database", "firewall", "firmware", "kernel", "offline", "patch", "reboot", "router", "software", "update", "upload", "wifi")
    #: Words that mark a technical joke but aren't jargon.
    tech_not_jargon: tuple[str, ...] = ("offline", "update")
    # Hard limits of words by style.
    word_limits: dict[str, int] = field(default_factory=lambda: {"formal": 58, "humorous_non_tech": 62, "sarcastic": 68, "humorous_tech": 68})
    default_word_limit: int = 72
    placeholders: tuple[str, ...] = ("No caption could be written for this clip, so this line stands in for it.",)


@dataclass(frozen=True)
class Settings:
    # Bars of the judges.
    judge_min_score: float = 0.9
    quality_floor: float = 0.9
    accuracy_floor: float = 0.75
    style_floor: float = 0.70
    similarity_warning: float = 0.65
    tie_margin: int = 8
    vision_confidence: float = 0.6
    vision_disagreement: float = 0.25
    vision_demote: float = 0.75
    # Seconds between frames, and the least and most frames, of short and of long clips.
    short_clip_s: float = 60.0
    short_interval_s: float = 4.0
    short_frames: tuple[int, int] = (8, 24)
    long_interval_s: float = 3.0
    long_frames: tuple[int, int] = (12, 28)
    #: This many frames for every clip, if given.
    fixed_frames: int | None = None
    width_short: int = 512
    width_long: int = 384
    min_setting_words: int = 3
    min_action_words: int = 4
    calibration_margin: float = 0.15
    calibration_rows: int = 15
    distinctness_warning: float = 0.6
