"""Word lists and thresholds of the analysis."""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values -----------------------------------------------------------

HYPE_TERMS = ("w", "wow", "holy", "insane", "clutch", "lfg", "pog", "pogchamp", "poggers", "hype", "crazy")
HYPE_PHRASES = ("no way",)
CONFUSION_TERMS = ("huh", "what", "wait", "why", "confused", "lost")
FRUSTRATION_TERMS = ("l", "throw", "threw", "choke", "choked", "bad", "troll", "awful", "terrible", "hate", "scam")
VALENCE_TERMS = {
    "amazing": 1.0, "clutch": 0.8, "funny": 0.3, "gg": 0.7, "great": 0.8, "hype": 0.6, "insane": 0.4,
    "love": 1.0, "pog": 0.7, "pogchamp": 0.8, "awful": -1.0, "bad": -0.7, "choke": -0.8, "hate": -1.0,
    "rough": -0.5, "sad": -0.5, "terrible": -1.0, "throw": -0.8, "troll": -0.7,
}
TARGET_STOP_WORDS = (
    "the", "and", "for", "you", "that", "this", "with", "was", "are", "but", "what", "wait", "huh", "why", "how",
    "wow", "holy", "insane", "clutch", "bad", "throw", "choke", "troll", "lfg", "pog", "way", "not", "now", "just",
)
BUCKET_STOP_WORDS = ("and", "are", "but", "for", "lol", "that", "the", "this", "was", "with")
SIGNAL_STOP_WORDS = (
    "the", "and", "for", "you", "that", "this", "with", "was", "are", "but", "what", "wait", "huh", "why", "how",
    "wow", "holy", "bad", "not", "now",
)
CHAT_POSITIVE = {
    "amazing": 1.0, "clutch": 0.9, "funny": 0.4, "gg": 0.8, "go": 0.4, "great": 0.9, "hype": 0.8, "insane": 0.7,
    "love": 1.0, "pogchamp": 0.9, "recovery": 0.4,
}
CHAT_NEGATIVE = {
    "awful": -1.0, "bad": -0.7, "hate": -1.0, "rough": -0.6, "sad": -0.5, "terrible": -1.0, "timing": -0.2,
}
SPEECH_TERMS = {
    "amazing": 1.0, "awesome": 0.9, "best": 0.8, "cool": 0.4, "funny": 0.4, "good": 0.5, "great": 0.9,
    "happy": 0.6, "insane": 0.5, "interesting": 0.3, "like": 0.4, "love": 1.0, "nice": 0.6, "perfect": 0.9,
    "thanks": 0.4, "wow": 0.5, "awful": -1.0, "bad": -0.7, "boring": -0.5, "confused": -0.4, "hate": -1.0,
    "hard": -0.2, "lost": -0.4, "rough": -0.6, "sad": -0.5, "scary": -0.4, "terrible": -1.0, "weird": -0.3,
    "wrong": -0.5,
}
LABEL_TERMS = {
    "amazing": 1.0, "awesome": 0.9, "best": 0.8, "clutch": 0.9, "cool": 0.4, "fire": 0.7, "funny": 0.4, "gg": 0.5,
    "good": 0.5, "great": 0.9, "happy": 0.6, "hype": 0.7, "insane": 0.5, "interesting": 0.3, "like": 0.4, "love": 1.0,
    "nice": 0.6, "perfect": 0.9, "pog": 0.8, "poggers": 0.8, "thanks": 0.4, "w": 0.6, "win": 0.6, "wow": 0.5,
    "awful": -1.0, "bad": -0.7, "boring": -0.5, "confused": -0.4, "hate": -1.0, "hard": -0.2, "lost": -0.4,
    "rough": -0.6, "sad": -0.5, "scary": -0.4, "throw": -0.5, "trash": -0.9, "terrible": -1.0, "ugh": -0.5,
    "weird": -0.3, "wrong": -0.5,
}
EVENT_LABELS = ("hype_spike", "frustration_spike", "audience_shift", "content_audience_divergence", "none")

SHIFT_DELTA = 0.45
SPIKE_RATIO = 0.55
SPIKE_SENTIMENT = 0.35
DIVERGENCE_DELTA = 0.45
WEAK_CONFIDENCE = 0.35
LABEL_CUTOFF = 0.15

# --- end of fixed values ----------------------------------------------------


@dataclass(frozen=True)
class ReactionLexicon:
    """Term sets behind the reaction scores; swap for another language or game."""

    hype: tuple[str, ...] = HYPE_TERMS
    phrases: tuple[str, ...] = HYPE_PHRASES
    confusion: tuple[str, ...] = CONFUSION_TERMS
    frustration: tuple[str, ...] = FRUSTRATION_TERMS
    valence: dict[str, float] = field(default_factory=lambda: dict(VALENCE_TERMS))
    target_stop_words: tuple[str, ...] = TARGET_STOP_WORDS
