"""Default parameters, in one place."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # contract of the audio chunks
    sample_rate: int = 16_000
    chunk_bytes: int = 6_400
    chunk_ms: int = 200
    # segments
    threshold: float = 0.5
    min_speech_ms: int = 96
    min_silence_ms: int = 500
    pad_ms: int = 256
    frame_ms: int = 32
    # utterances
    max_utterance_ms: int = 7_000
    partial_every_ms: int = 600
    split_search_ms: int = 500
    partial_window_ms: int = 4_000
    # labels
    min_speech: float = 0.2
    min_noise: float = 0.3
    label_window_ms: int = 10_000
    # levels
    envelope_ms: int = 20
    speaking_percentile: float = 0.9
    gate_db: float = -12.0
    compressor_db: float = 3.0
    floor_dbfs: float = -55.0
    # voices
    same_voice: float = 0.3
    min_voice_ms: int = 600
    max_speakers: int = 12
    momentum: float = 0.7
    recluster_every: int = 15
    voices_kept: int = 300
    voice_change: float = 0.25
    # language
    languages: tuple = ("vi", "ja")
    language_margin: float = 0.3
    probe_ms: int = 600
    probe_steps: int = 3
    # guards
    no_speech: float = 0.6
    short_ms: int = 600
    prompt_chars: int = 400
    min_logprob: float = -1.0
    max_repetition: float = 2.4
    # answers
    history: int = 3
    max_lag_s: float = 10.0
    backlog: int = 16
    wrong_script: float = 0.3
    extra_chars: int = 50
    # transcript, stages
    rows_kept: int = 500
    failures: int = 3
    slow_s: float = 1.0

    @property
    def neg_threshold(self) -> float:
        return max(self.threshold - 0.15, 0.01)

    @property
    def open_frames(self) -> int:
        return max(1, round(self.min_speech_ms / self.frame_ms))

    @property
    def close_frames(self) -> int:
        return max(1, round(self.min_silence_ms / self.frame_ms))

    @property
    def pad_frames(self) -> int:
        return round(self.pad_ms / self.frame_ms)


DEFAULTS = Settings()
