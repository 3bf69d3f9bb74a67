"""Tables and parameters.

words   media_id, segment_ix, word_ix, text, start, end, type, speaker, confidence
lines   media_id, line_ix, start_ms, end_ms, style, text, speaker
groups  media_id, group_ix, start_ix, end_ix, n_lines

``line_ix`` counts from 0 without gaps within a media; times are offsets from the
start of the media.
"""

from __future__ import annotations

from dataclasses import dataclass

# File suffixes, flags and defaults that results depend on.
CONTINUE_FLAG = "%%CONT%%"
VIDEO_SUFFIXES = (".mp4", ".mkv", ".webm", ".ts", ".flv", ".mov", ".avi", ".wmv")
AUDIO_SUFFIXES = (".oga", ".mp3", ".aac", ".m4a", ".wav", ".flac", ".opus", ".ogg", ".ac3", ".eac3")
JSON_SUFFIXES = (".json",)
SUBTITLE_SUFFIXES = (".srt", ".ass", ".ssa", ".vtt", ".sbv")
TEXT_SUFFIXES = (".txt",)
IMAGE_SUFFIXES = (".jpg", ".bmp", ".png", ".jpeg", ".webp")
STAGE_SUFFIXES = (".padded", ".en", ".padded_custom", ".tr_custom", ".fixed_custom", ".partial", ".2pass", ".2pass_custom", ".context", ".fixed", ".raw")
CODEC_EXTENSIONS = (
    ("aac", "m4a"),
    ("mp3", "mp3"),
    ("opus", "ogg"),
    ("vorbis", "ogg"),
    ("flac", "flac"),
    ("ac3", "ac3"),
    ("eac3", "eac3"),
    ("pcm_s16le", "wav"),
    ("pcm_s24le", "wav"),
    ("pcm_f32le", "wav"),
)
WORD_TYPES = ("word", "audio_event", "spacing")
MISSING_TRANSLATION = "[Translation missing]"


@dataclass(frozen=True)
class Params:
    """Defaults of every stage."""

    delimiters: tuple[str, ...] = ("。", "？", "！", "-", "?", "!", "」", "「")
    soft_delimiters: tuple[str, ...] = ("、", " ", "　")
    remove_text: tuple[str, ...] = ("」", "「")
    soft_max_chars: int = 20
    hard_max_chars: int = 50
    hard_max_carryover: int = 15
    max_time_gap_sec: float = 2.0

    mistimed_line_thresh_sec: float = 0.1

    max_lead_out_sec: float = 2.0
    max_lead_in_sec: float = 0.25
    max_cps: float = 15.0
    min_sec: float = 1.0

    mistimed_seg_thresh_sec: float = 0.1
    seg_min_lines: int = 4
    seg_backtrace_limit: int = 20
    seg_foretrace_limit: int = 5
    seg_min_delay_sec: float = 10.0
    seg_max_gap: int = 4

    context_lines: int = 100
    batch_lines: int = 50
    discard_lines: int = 10
    translate_retries: int = 3
    server_retries: int = 20
    max_cont_lines: int = 5
