"""Names and fixed values of the event model."""

# The closed list of event types, and the heartbeat events that decide a state.
EVENT_TYPES = ("VideoSessionStart", "VideoPlay", "VideoHeartbeat", "AppBackgrounded", "AppForegrounded", "VideoSessionEnd", "VideoError")
PAUSES = ("pause", "speed-pause", "AdPause")
RESUMES = ("resume", "speed-resume", "AdResume")

#: Dimensions by which curves can be filtered.
DIMS = ("platform", "country", "video_type", "content_id", "app_version", "audio_language", "subtitle_language", "player_version", "video_resolution")
#: Those that an event carries; video_type comes from the catalogue.
EVENT_DIMS = tuple(d for d in DIMS if d != "video_type")
#: Dimensions of the insight tables.
INSIGHT_DIMS = ("content_id", "platform", "country", "video_type", "app_version")

TOLERANCE = 90
LATE_AFTER, FINAL_AFTER = 90, 3600
EVENT_SCHEMA = (
    "content_id long, video_session_id string, user_id string, event_type string, event string, event_timestamp long, platform string, app_version string, "
    "country string, audio_language string, subtitle_language string, player_version string, session_start_epoch long, video_resolution string"
)
CONTENT_SCHEMA = "content_id long, title string, video_type string, category string, show_name string"
