"""Texts, word lists, patterns and limits that results depend on.

Every operator takes these as defaults of ordinary parameters.
"""

# --- fixed values: prompts and markers -------------------------------------------------
CHAT_SYSTEM = (
    "You are an immersive roleplay assistant. Stay in character, emotionally consistent, "
    "descriptive, and coherent across turns."
)
SFT_SYSTEM = (
    "You are an immersive roleplay assistant. Stay in character, emotionally consistent, "
    "and coherent across turns."
)
FALLBACK_SYSTEM = "You are a helpful roleplay assistant."
SYSTEM_MARK = "<|system|>"
USER_MARK = "<|user|>"
ASSISTANT_MARK = "<|assistant|>"
END_MARK = "</s>"
TRUNCATED_USER = "(truncated)"
INTRODUCE_USER = "Introduce yourself in-character."
ACT_SYSTEM = "Roleplay as: "
NONE_BLOCK = "(none)"
KEEP_CHARACTER_LINE = "Never break character unless explicitly instructed by the system."
KEEP_CHARACTER_SHORT = "Never break character unless explicitly asked by system instructions."

# --- fixed values: role names ------------------------------------------------------------
USER_ROLES = ["user", "human"]
ASSISTANT_ROLES = ["assistant", "gpt"]
SYSTEM_ROLE = "system"
TRANSCRIPT_USER_ROLES = ["human", "user", "prompter"]

# --- fixed values: record keys probed in order ---------------------------------------------
QUESTION_KEYS = ["instruction", "prompt", "question"]
ANSWER_KEYS = ["output", "response", "answer"]
SOURCE_SIDE_KEYS = ["src", "input", "prompt", "question", "human"]
TARGET_SIDE_KEYS = ["tgt", "output", "response", "answer", "assistant"]

# --- fixed values: limits ------------------------------------------------------------------
MAX_CHARS = 32_000
MAX_TURNS = 12
MIN_REPLY_CHARS = 20
MIN_TEXT_CHARS = 20
MIN_SFT_CHARS = 2
MIN_LOG_SCORE = 0.8
MAX_TOKENS = 1024
SHUFFLE_BUFFER = 512
ROWS_PER_SOURCE = 30_000
ATTACHMENT_BYTES = 64_000
HISTORY_PAIRS = 12
RECENT_MESSAGES = 24
TOP_MEMORIES = 12
MEMORY_CAPACITY = 50_000
MEMORY_DIM = 384
RETRIEVE_K = 4
OVERFETCH = 3
SAVE_PERSONA_AFTER = 50
RUN_STEPS = 800
STEP_BATCH = 2
STEP_ACCUMULATION = 8
SEED = 42

# --- fixed values: emotions, in order of priority --------------------------------------------
EMOTION_CUES = {
    "happy": ["thank", "great", "wonderful", "love", "glad"],
    "angry": ["angry", "furious", "hate", "idiot", "stupid"],
    "curious": ["why", "how", "what if", "curious", "wonder"],
    "suspicious": ["liar", "sus", "suspicious", "betray"],
    "fearful": ["help", "scared", "afraid", "terror", "panic"],
}
EMOTIONS = ["happy", "angry", "curious", "suspicious", "fearful", "neutral"]
DEFAULT_EMOTION = "neutral"

# --- fixed values: world state -----------------------------------------------------------------
LOCATION_CUES = ["we are in"]
TIME_CUES = ["night", "dawn", "midday", "evening"]
EVENT_CUES = ["quest", "mission", "objective"]
CLIFFHANGER_CUES = ["the chapter ends", "to be continued"]
WORLD_DEFAULTS = {
    "location": "unknown",
    "time": "unknown",
    "current_event": "none",
    "story_progress": "beginning",
}

# --- fixed values: memory importance -------------------------------------------------------------
IMPORTANT_PHRASES = [
    "my name is",
    "i am",
    "i live",
    "i like",
    "remember",
    "never forget",
    "secret",
    "quest",
    "artifact",
]

# --- fixed values: persona instructions --------------------------------------------------------------
PERSONA_LEADS = [
    r"(?:be|become)\s+",
    r"act\s+like\s+",
    r"pretend\s+to\s+be\s+",
    r"roleplay\s+as\s+",
    r"you\s+are\s+",
]
PERSONA_ARTICLE = r"(?:an?\s+|the\s+)?"
PERSONA_NAME = r"([^,.!?;\n]{2,80})"
PERSONA_SUFFIXES = [
    " for today ",
    " for now ",
    " in this chat ",
    " in this conversation ",
    " in this roleplay ",
]
GENERIC_PERSONAS = [
    "honest",
    "nice",
    "kind",
    "polite",
    "quiet",
    "serious",
    "helpful",
    "my friend",
]
PERSONA_DEFAULT_REMAINDER = "Begin."

SWITCH_LEADS = [
    r"(?:be|become)\s+",
    r"act like\s+",
    r"act as\s+",
    r"talk like\s+",
    r"roleplay as\s+",
    r"pretend to be\s+",
]
SWITCH_SEPARATORS = [
    " and ",
    " then ",
    " today",
    " tonight",
    " for ",
    " while ",
    " now ",
    " this ",
    " please ",
    " but ",
]
SWITCH_REMAINDER_LEADS = ["and ", "then ", "please ", "to "]
SWITCH_EMPTY_LEADS = ["today", "for ", "and "]
SWITCH_DEFAULT_REMAINDER = "Hello."
SWITCH_DEFAULT_PERSONA = "a helpful roleplay assistant"

PERSONA_HINTS = [
    (
        ["iron man", "tony stark"],
        "Witty, confident, tech-savvy, slightly sarcastic. Refer to armor and tech casually.",
    ),
    (
        ["wise mentor", "mentor"],
        "Calm, encouraging, uses short parables or practical advice.",
    ),
    (["funny", "friend"], "Light, playful tone. Short humor or gentle teasing."),
]
PERSONA_RULES = [
    "Rules:",
    "- Fully embody the persona and speak as them directly.",
    "- Never say you are 'trying' or 'pretending'; just be the character.",
    "- Do NOT mention being an AI, model, or assistant.",
    "- Do NOT break character or explain the role.",
    "- If the user asks to switch personas, immediately adopt the new persona.",
    "- Keep replies concise unless asked for more detail.",
]

# --- fixed values: profiles --------------------------------------------------------------------------
PROFILE_REQUIRED = [
    "name",
    "role",
    "personality",
    "speech_style",
    "background",
    "emotions",
    "motivations",
]
PROFILE_OPTIONAL = "behavior_rules"
PROFILE_TEMPLATE = {
    "personality": "Stay consistent with the persona implied by the name; be immersive and coherent.",
    "speech_style": "Match the persona's typical voice; keep responses natural and in-character.",
    "background": "User-defined persona for this conversation.",
    "emotions": "Emotionally consistent; react appropriately to the scene and user tone.",
    "motivations": "Engage the user in roleplay; advance the conversation and maintain continuity.",
}
DEFAULT_CHARACTER = "wizard"
DEFAULT_SLUG = "character"

# id, name, personality, world, tone
STORE_CHARACTERS = [
    ("wizard", "Wizard", "Ancient magical teacher; wise and mysterious.", "Fantasy",
     "Wise, descriptive, emotionally consistent."),
    ("detective", "Detective", "Sharp, skeptical, detail-oriented investigator.", "Noir city",
     "Concise, probing questions, grounded."),
    ("historian", "Historian", "Curious scholar who cites context and asks clarifying questions.",
     "Any era you choose", "Clear, reflective, precise."),
    ("space_captain", "Space Captain", "Decisive leader; pragmatic; protective of crew.",
     "Deep space frontier", "Confident, tactical, cinematic."),
]
ALWAYS_SEEDED = ["wizard", "detective"]
PLACEHOLDER_CHARACTER = ("Character", "roleplay", "world", "tone")

# --- fixed values: stages ------------------------------------------------------------------------------
STAGES = ["stage1_instruction", "stage2_roleplay", "stage3_preference"]
