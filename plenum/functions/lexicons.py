"""Word lists and rates of the scoring rules. Fixed values, given as data so that users can pass their own."""

from __future__ import annotations

JARGON = ("actuarial", "framework", "optimization", "mechanism", "comprehensive", "enhancement", "sustainability", "inter-generational", "risk-pooling", "ecosystem", "synergy", "paradigm", "holistic", "leveraging", "stakeholder", "modalities", "calibration", "recalibration")
CONTRADICTIONS = (
    (("modest", "small", "minor"), ("significantly", "substantially", "major")),
    (("affordable", "cheap"), ("expensive", "costly", "rise", "increase")),
    (("simple", "straightforward"), ("complex", "complicated")),
    (("will", "definitely"), ("might", "maybe", "possibly")),
)
EVERYDAY = ("healthcare", "health", "insurance", "housing", "hdb", "education", "school", "transport", "mrt", "bus", "taxi", "cost of living", "prices", "wages", "salary", "jobs", "employment", "cpf", "retirement", "childcare", "elderly care")
STRONG_TONES = ("angry", "defensive", "evasive", "frustrated", "shocked")
MEDIUM_TONES = ("concerned", "worried", "confused", "skeptical")
PERSONA_MARKERS = {
    "gen_z": ("bestie", "it's giving", "i can't", "the way", "make it make sense", "tell me", "not the", "literally"),
    "kopitiam_uncle": ("lah", "leh", "lor", "wah lau", "aiyah", "liddat", "can ah", "how to", "so nice"),
    "auntie": ("aiyoh", "how?", "then how", "so stress", "cannot like that", "my family", "must plan"),
    "attenborough": ("here", "observe", "in nature", "curious", "remarkable", "behavior", "chamber"),
}
MARKERS_NEEDED = {"gen_z": 2, "kopitiam_uncle": 3, "auntie": 2, "attenborough": 2}
WORDS_PER_SECOND = {"gen_z": 3.5, "kopitiam_uncle": 3.2, "auntie": 3.0, "attenborough": 2.5}
#: Topic words, in order of priority, and the personas that they favour.
AFFINITIES = (
    (("health", "insurance", "medical"), ("auntie", "kopitiam_uncle")),
    (("housing", "cost", "price"), ("kopitiam_uncle", "auntie")),
    (("education", "young", "jobs"), ("gen_z",)),
    (("policy", "complex", "system"), ("attenborough",)),
)
#: Prices per million tokens: model, input, output.
PRICES = (("gpt-5-mini", 0.25, 2.0), ("gpt-5-nano", 0.0, 0.0))
