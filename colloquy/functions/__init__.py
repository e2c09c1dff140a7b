from colloquy.functions.numbers import (
    audio_seconds,
    cosine_distance,
    fit_length,
    float_to_pcm16,
    format_ticks,
    micros,
    pad_short,
    pcm_to_float,
    smooth_labels,
    too_short,
)
from colloquy.functions.text import (
    clean_text,
    lstrip_set,
    min_length,
    not_comment,
    regex_trim,
    word_count,
)

__all__ = [
    "audio_seconds", "clean_text", "cosine_distance", "fit_length", "float_to_pcm16",
    "format_ticks", "lstrip_set", "micros", "min_length", "not_comment", "pad_short",
    "pcm_to_float", "regex_trim", "smooth_labels", "too_short", "word_count",
]
