"""Results depend on these exact words, patterns and constants."""

# --- fixed: patterns in comments; factors turn the captured groups into seconds
TIMESTAMP_PATTERNS = [
    (r"\b(\d{1,2}):(\d{2}):(\d{2})\b", (3600.0, 60.0, 1.0)),
    (r"\b(\d{1,2}):(\d{2})\b", (60.0, 1.0)),
    (r"(?i)\bat\s+(\d+)\s*(?:min(?:ute)?s?)\b", (1.0,)),
    (r"(?i)\b(\d+)\s*(?:sec(?:ond)?s?)\b", (1.0,)),
]
NUMBER_PATTERN = r"\b\d[\d,.:]*\d|\b\d+\b"
SPAM_PATTERNS = [
    r"(?i)(subscribe|sub to|check out my|follow me|promo code)",
    r"(?i)(free\s+(?:v-?bucks|gift|iphone|money))",
    r"(?i)(https?://\S+){2,}",
    r"(.)\1{7,}",
    r"[A-Z\s]{30,}",
]
QUICK_SPAM_PHRASES = ["subscribe", "check out my", "promo code", "free gift"]

# --- fixed: recogniser label to entity type
ENTITY_TYPES = {
    "person": ["PERSON"],
    "organization": ["ORG", "NORP"],
    "location": ["GPE", "LOC", "FAC"],
    "product": ["PRODUCT"],
    "event": ["EVENT"],
    "concept": ["WORK_OF_ART", "LAW"],
}

# --- fixed: transcript clean-up
ASR_FILLERS = ["um", "uh", "hmm", "huh", "like", "you know", "i mean", "basically", "actually", "right"]
LOOP_PATTERNS = [
    r"(.{10,}?)\1{3,}",
    r"(?i)(thank you\.?\s*){4,}",
    r"(?i)(please subscribe\.?\s*){3,}",
    r"(?i)(music\.?\s*){5,}",
    r"(\.\.\.){5,}",
]

# --- fixed: query understanding
EMOTION_WORDS = [
    "happy", "sad", "angry", "frustrated", "excited", "scared", "surprised", "confused", "bored", "struggling",
    "laughing", "crying", "arguing", "shouting", "whispering", "nervous", "calm", "panicking", "celebrating",
    "depressed", "anxious", "joyful", "furious", "terrified",
]
ACTION_WORDS = [
    "playing", "cooking", "eating", "running", "walking", "talking", "explaining", "presenting", "coding", "typing",
    "drawing", "painting", "singing", "dancing", "fighting", "arguing", "debating", "reviewing", "unboxing",
    "building", "fixing", "breaking", "stealing", "throwing", "catching", "jumping", "swimming", "driving", "flying",
    "reading", "writing", "watching", "streaming", "recording", "interviewing", "teaching", "learning", "studying",
    "working", "sleeping", "discussing", "showing", "demonstrating",
]
QUERY_STOPWORDS = [
    "a", "an", "the", "is", "are", "was", "were", "in", "on", "at", "to", "for", "of", "with", "by", "from", "up",
    "about", "into", "through", "during", "before", "after", "above", "below", "between", "where", "when", "who",
    "what", "how", "why", "which", "that", "this", "they", "them", "their", "he", "she", "it", "his", "her", "and",
    "but", "or", "not", "no", "so", "if", "then", "than", "very", "just", "really", "some", "any", "all", "each",
    "every", "guy", "person", "someone", "thing", "stuff",
]
ERA_PATTERNS = [
    (r"\b(retro|vintage|old school|classic|90s|80s|70s|60s)\b", "retro"),
    (r"\b(modern|recent|new|2024|2023|2025|latest|current)\b", "modern"),
    (r"\b(night|nighttime|dark|evening)\b", "night"),
    (r"\b(daytime|morning|afternoon|bright)\b", "daytime"),
]
CONTEXT_PATTERNS = [
    (r"\b(podcast|interview|talk show|radio)\b", "podcast/interview"),
    (r"\b(tutorial|how.?to|guide|lesson|course)\b", "tutorial"),
    (r"\b(review|unboxing|first look|hands.?on)\b", "review"),
    (r"\b(vlog|daily|routine|day in)\b", "vlog"),
    (r"\b(gaming|gameplay|playthrough|lets? play)\b", "gaming"),
    (r"\b(news|breaking|report|coverage)\b", "news"),
    (r"\b(music|song|concert|performance|live)\b", "music"),
    (r"\b(sport|game|match|tournament|championship)\b", "sports"),
]
ACOUSTIC_TERMS = [
    "music", "singing", "applause", "laughter", "cheering", "crowd", "gunshot", "explosion", "siren", "silence",
    "noise", "typing", "fast", "slow", "upbeat", "dramatic", "bass", "loud", "quiet", "robotic", "autotune", "echo",
    "reverb", "pitch", "speed",
]

# --- fixed: fusion weights, sum 1
FUSION_WEIGHTS = {
    "text_semantic": 0.20,
    "visual_similarity": 0.12,
    "ocr_match": 0.08,
    "keyword_match": 0.07,
    "temporal_coherence": 0.05,
    "emotion_context": 0.02,
    "comment_semantic": 0.08,
    "comment_timestamp_boost": 0.03,
    "agreement_cluster": 0.03,
    "entity_overlap": 0.03,
    "user_cluster_confidence": 0.03,
    "audio_event_match": 0.08,
    "audio_attribute_match": 0.07,
    "alignment_quality": 0.06,
    "change_point_proximity": 0.05,
}
INCLUSION_THRESHOLDS = {"text_semantic": 0.25, "visual_similarity": 0.15, "ocr_match": 0.30, "keyword_match": 0.0}

# --- fixed: crawl priority rules
PRIORITY_RULES = {
    "weight_views": 1.0,
    "weight_recency": 0.5,
    "min_views": 100,
    "min_duration_seconds": 30,
    "max_duration_seconds": 14400,
    "keyword_boosts": {
        "tutorial": 10, "explained": 8, "review": 5, "how to": 7, "deep dive": 8, "breakdown": 6, "analysis": 6,
        "podcast": 4, "interview": 5, "debate": 5, "gaming": 3, "gameplay": 3,
    },
    "accepted_languages": [],
    "max_age_days": 365,
    "tier_multipliers": {"1": 1.0, "2": 1.5, "3": 2.0, "4": 3.0, "5": 5.0},
}

# --- fixed: confidence bands (lower bound, key, label, colour)
CONFIDENCE_BANDS = [
    (0.00, "weak", "Weak", "#6b6b7b"),
    (0.25, "low", "Low", "#f08c3a"),
    (0.50, "moderate", "Moderate", "#f5a623"),
    (0.75, "strong", "Strong", "#3ddc84"),
    (0.90, "very_strong", "Very Strong", "#2ecc71"),
]
CALIBRATION_TARGETS = {
    "audio.speed_anomaly": "platt",
    "audio.pitch_shift": "platt",
    "audio.compression": "isotonic",
    "audio.reverb_echo": "platt",
    "audio.robotic_autotune": "platt",
    "audio.time_stretch": "platt",
    "audio.overall_manipulation": "isotonic",
    "audio.music_probability": "temperature",
    "audio.speech_probability": "temperature",
    "ocr.confidence": "isotonic",
    "whisper.segment_confidence": "temperature",
    "clip.label_confidence": "temperature",
    "search.final_score": "isotonic",
}

# --- fixed: linguistic style
BE_VERBS = ["was", "were", "been", "being", "is", "are", "am", "be"]
STYLE_HEDGES = [
    "maybe", "perhaps", "possibly", "probably", "might", "could", "seems", "appears", "suggest", "think", "believe",
    "assume", "somewhat", "rather", "fairly", "relatively", "arguably",
]
STYLE_FILLERS = ["um", "uh", "like", "you know", "basically", "literally", "actually", "so"]
STYLE_SLANG = [
    "gonna", "wanna", "gotta", "kinda", "sorta", "dunno", "ain't", "y'all", "nah", "yeah", "yep", "nope", "dude",
    "bro", "lol",
]
FIRST_PERSON = ["i", "me", "my", "mine", "myself"]
SECOND_PERSON = ["you", "your", "yours", "yourself"]

# --- fixed: semantic intent; order decides ties
INTENT_PHRASES = {
    "tutorial": ["how to", "step by step", "tutorial", "guide", "learn", "install", "setup", "walkthrough"],
    "satire": ["imagine", "obviously", "totally", "clearly joking", "satire", "parody"],
    "rant": ["annoyed", "frustrated", "sick of", "why is", "ridiculous", "unacceptable", "rant"],
    "news": ["breaking", "reports", "according to", "officials", "update", "coverage", "investigation"],
    "advertisement": ["sponsored", "discount", "code", "link below", "check out", "offer", "free trial"],
    "review": ["review", "rating", "pros and cons", "worth it", "recommend", "compared to", "unboxing"],
    "educational": ["explain", "theory", "concept", "principle", "understand", "definition", "fundamentally"],
    "vlog": ["today I", "my day", "went to", "hanging out", "morning routine", "what I ate"],
}
PERSUASION_PHRASES = {
    "logical": ["therefore", "because", "evidence", "data", "study", "research", "proves", "logically"],
    "emotional": ["feel", "imagine", "heartbreaking", "amazing", "incredible", "devastating", "beautiful"],
    "authority": ["expert", "professor", "according to", "PhD", "published", "credentials", "years of experience"],
    "social_proof": ["everyone", "millions", "trending", "popular", "most people", "community"],
    "scarcity": ["limited", "exclusive", "only", "running out", "hurry", "last chance", "rare"],
}
CERTAINTY_WORDS = [
    "definitely", "certainly", "absolutely", "clearly", "obviously", "undoubtedly", "always", "never", "fact",
]
INTENT_HEDGES = ["maybe", "perhaps", "might", "could", "possibly", "seems", "apparently", "arguably", "I think"]
POSITIVE_FRAMES = ["great", "excellent", "wonderful", "best", "amazing", "incredible"]
NEGATIVE_FRAMES = ["terrible", "worst", "horrible", "disgusting", "awful", "pathetic"]
CALLS_TO_ACTION = [
    "subscribe", "hit the bell", "like this video", "comment below", "share", "link in", "check out",
]

# --- fixed: signals
SPONSOR_LEXICON = {
    "sponsor": ["sponsored", "discount", "code", "offer", "free trial"],
    "self_promo": ["patreon", "membership"],
    "interaction_reminder": ["subscribe", "hit the bell", "like this video"],
    "merch": ["merch", "store"],
}
AFFILIATE_DOMAINS = ["amzn.to", "bit.ly"]
REQUEST_PHRASES = ["can you", "please", "follow-up", "video on"]
SIGNAL_CATEGORIES = {
    "temporal_visual": ["cursor_heatmaps", "text_edit_events", "face_camera_ratios", "background_changes"],
    "audio_micro": ["breathing_patterns", "ambient_bleeds", "room_fingerprints", "laughter_events"],
    "behavioral": ["upload_patterns", "title_edit_history", "thumbnail_analyses", "link_health"],
    "comment_archaeology": ["pinned_comment_history", "sentiment_drifts", "deleted_shadows"],
    "cross_video_forensics": ["broll_reuses", "sponsor_segments", "intro_outro_evolutions"],
    "linguistic": ["linguistic_profiles"],
    "graph_relational": ["commenter_migrations", "entity_propagations", "parasocial_indices", "topic_gestations"],
    "recrawl": ["recrawl_events"],
}
GRAPH_EVENT_TYPES = [
    "VIDEO_ADDED", "COMMENT_ADDED", "USER_CREATED", "ENTITY_DISCOVERED", "CHANNEL_LINKED", "COMMENT_LINKED",
    "USER_CONNECTED", "ENTITY_CO_OCCURRENCE", "THREAD_EXPANDED", "HEARTBEAT", "STATS_UPDATE",
]
TIMEZONE_NAMES = {
    -8: "PST", -7: "MST", -6: "CST", -5: "EST", 0: "UTC", 1: "CET", 2: "EET", 3: "AST", 8: "CST_CN", 9: "JST",
}
VIDEO_TRACKED_FIELDS = [
    "title", "description", "view_count", "like_count", "dislike_count", "comment_count", "tags", "categories",
    "thumbnail_url", "duration_seconds", "live_status", "chapters_json", "captions_info", "age_limit", "is_short",
    "has_captions", "caption_languages", "has_auto_captions", "auto_caption_languages",
]
CHANNEL_TRACKED_FIELDS = [
    "name", "description", "subscriber_count", "total_videos", "banner_url", "country", "custom_url",
]
