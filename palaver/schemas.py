"""Row types of the data model, as Spark DDL."""

SEGMENT = "session_id string, pos bigint, at double, text string, source string, speaker int, provisional boolean, seq bigint"
COMMIT = "session_id string, seq bigint, text string, from_chunk bigint, to_chunk bigint, speaker int, provisional boolean"
CHUNK_LABEL = "session_id string, chunk bigint, speaker int, provisional boolean, boundary boolean"
RELABEL = "session_id string, arrival bigint, from_chunk bigint, to_chunk bigint, speaker int"
AUDIO_CHUNK = "stream_id string, chunk bigint, samples array<float>"
VAD_FRAME = "stream_id string, frame bigint, prob double, voiced boolean"
EMBEDDING = "stream_id string, ord bigint, t0 double, t1 double, kind string, vector array<float>"
REFERENCE_WORD = "meeting string, speaker string, start double, end double, punc boolean"
SOURCE = "target bigint, name string, kind string, detail string, stable_name string, sink_description string"
#: One wide row for every kind of message that a server sends.
SERVER_MESSAGE = (
    "type string, session_id string, chunk_ms int, model string, diarize boolean, seq bigint, text string, speaker int, speaker_provisional boolean, "
    "retract_n bigint, from_seq bigint, to_seq bigint, code string, message string, retryable boolean, reason string"
)
CLIENT_MESSAGE = "type string, mode string, diarize boolean, sample_rate int, encoding string, language string, vocabulary array<string>"
