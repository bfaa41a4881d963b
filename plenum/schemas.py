"""Schemas of the source tables; nothing is inferred."""

from __future__ import annotations

RAW_SESSION = (
    "metadata STRUCT<parlimentNO: INT, sessionNO: INT, volumeNO: INT, sittingDate: STRING, dateToDisplay: STRING, startTimeStr: STRING, speaker: STRING>, "
    "takesSectionVOList ARRAY<STRUCT<startPgNo: INT, title: STRING, sectionType: STRING, content: STRING, questionCount: INT, subsections: ARRAY<STRUCT<title: STRING, content: STRING>>>>, "
    "attendanceList ARRAY<STRUCT<mpName: STRING, attendance: BOOLEAN>>, "
    "format STRING, cleanedContent STRUCT<fullText: STRING, columns: ARRAY<STRING>>"
)
CAPTION_LIST = "segments ARRAY<STRUCT<start: DOUBLE, end: DOUBLE, text: STRING>>"
WORD_LIST = "segments ARRAY<STRUCT<id: INT, start: DOUBLE, end: DOUBLE, text: STRING, words: ARRAY<STRUCT<word: STRING, start: DOUBLE, end: DOUBLE, probability: DOUBLE>>>>"
VIDEO_MAP = "MAP<STRING, STRUCT<video_id: STRING, title: STRING, has_hansard: BOOLEAN>>"
ANALYSIS = "STRUCT<quote: STRING, speaker: STRING, why_viral: STRING, ai_score: DOUBLE, topic: STRING, emotional_tone: STRING, target_demographic: STRING, contains_jargon: BOOLEAN, has_contradiction: BOOLEAN, affects_everyday_life: BOOLEAN, segment_indices: ARRAY<INT>>"
