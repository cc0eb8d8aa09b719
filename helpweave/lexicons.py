"""Word lists, phrase tables and numeric defaults.

Every list here is a value that results depend on. They are plain Python data so a
caller can pass replacements to the functions that use them.
"""

from __future__ import annotations

# --- Fixed values: intent signature -------------------------------------------------
DOMAIN_WORDS = {
    "Display": "screen display flicker flickering flashes flashing blank black white lines green pink dim "
               "brightness touch touchscreen refresh hz peeling cracked crack glass damage pixels tint resolution",
    "Battery": "battery charge charging drain drains draining dies dying power charger cable percentage "
               "overheat overheating warm heat",
    "Performance": "lag lagging slow sluggish freeze freezes freezing frozen hang hangs crashed crashes crashing "
                   "stutter restart rebooting bootloop unresponsive ram storage",
    "Connectivity": "wifi bluetooth network sim signal cellular data internet hotspot gps pairing",
    "Audio": "speaker sound volume audio mic microphone crackling silent buzzing distortion earpiece headphones",
    "Camera": "camera lens photo video blurry focus shutter flash",
}
# Substring that makes an otherwise unknown text a Display text.
DISPLAY_FALLBACK = ["screen", "display", "flicker"]

COMPONENT_PHRASES = [
    ("brightness", ["brightness", "dim", "dark", "blinding"]),
    ("refresh_rate", ["refresh", "hz", "motion smoothness", "120hz", "60hz"]),
    ("charging", ["charge", "charging", "cable", "plug", "wireless charge"]),
    ("battery_drain", ["drain", "dies", "dying", "battery life", "consumption"]),
    ("touch", ["touch", "touchscreen", "tap", "responsive", "unresponsive"]),
    ("navigation_bar", ["navigation bar", "gestures", "buttons"]),
    ("screen_damage", ["cracked", "crack", "broken", "peeling", "lines", "green line"]),
    ("wifi", ["wifi", "wi-fi", "wireless network"]),
    ("bluetooth", ["bluetooth", "pair", "pairing", "headphones"]),
    ("audio_speaker", ["speaker", "audio", "sound", "volume"]),
]
SYMPTOM_PHRASES = [
    ("flicker", ["flicker", "flickering", "flashes", "flashing", "blink", "blinking"]),
    ("blank", ["blank", "black", "white", "blackout", "nothing appears"]),
    ("drain", ["drain", "draining", "drains", "dies fast", "depleting"]),
    ("freeze", ["freeze", "freezes", "freezing", "stuck", "hang", "hangs"]),
    ("not_charging", ["not charging", "wont charge", "refuses to charge", "slow charging", "stopped charging"]),
    ("overheat", ["overheat", "overheating", "hot", "warm", "heat"]),
    ("damage", ["cracked", "broken", "peeling", "lines"]),
    ("slow", ["slow", "lag", "sluggish", "stutter"]),
]
NEGATION_WORDS = [
    "not", "no", "cant", "can't", "cannot", "wont", "won't", "unable", "doesnt", "doesn't", "fails", "failed",
    "never", "refuses", "stop", "stopped", "without", "off", "disable", "disabled", "disabling", "deactivate",
    "deactivated", "mute",
]
TRIGGER_PATTERNS = [
    ("after_update", r"\b(?:after|since|following)\s+(?:the\s+)?(?:software\s+)?update\b"),
    ("after_drop", r"\b(?:after|since)\s+(?:dropping|drop|fell|water|liquid|damage)\b"),
    ("while_charging", r"\b(?:while|when|during)\s+(?:charging|plugged\s+in)\b"),
    ("during_call", r"\b(?:during|in|on)\s+(?:a\s+)?(?:phone\s+)?call\b"),
    ("on_app_open", r"\b(?:when|whenever|after)\s+(?:opening|tapping|launching)\s+[a-z0-9]+\b"),
]
OPPOSED_SYMPTOMS = [("drain", "not_charging"), ("blank", "flicker"), ("slow", "damage")]
COMMAND_ON = r"\b(?:turn(?:ing)? on|switch(?:ing)? on|enable|enabling|activate)\b"
COMMAND_OFF = r"\b(?:turn(?:ing)? off|switch(?:ing)? off|disable|disabling|deactivate)\b"
CLAUSE_SEPARATOR = (
    r"(?:;\s*|,\s*(?:and|also|plus|but)\s*|\s+(?:and also|as well as|along with|and|plus|also)\s+)"
)

# --- Fixed values: lexical tokens ---------------------------------------------------
SYNONYM_GROUPS = [
    ["black", "blank", "dark", "dead", "nothing", "blackout"],
    ["flicker", "flash", "blink", "flickering", "flashing", "flickers", "flashes", "strobe", "glitch"],
    ["crack", "cracked", "shatter", "shattered", "broken", "smashed"],
    ["lag", "laggy", "slow", "delay", "delayed", "sluggish"],
    ["screen", "display", "panel"],
    ["phone", "device", "galaxy", "samsung", "tablet", "mobile"],
    ["crash", "crashes", "crashing", "closes", "stops", "stopped"],
    ["charge", "charging", "charger"],
    ["drain", "drains", "dies", "dying", "loses", "drop", "drops"],
]
LEXICAL_STOP_WORDS = (
    "a an the my i me is it its and or to of on in at for with when while after before just then "
    "but so this that be been being am are was were do does did have has had can cant wont not no any "
    "some every all very really super like how what why fix help please get keeps keep still also now "
    "again even only there their they you your our we us from into out up down about would could should"
)
MODEL_NUMBER = r"\b[A-Za-z]{0,2}\d+[A-Za-z0-9+/]*\b"
GENERIC_SETTING_WORDS = (
    "enable disable view check adjust open opens enables disables updates specified value settings "
    "setting device page screen mode show turn off with from your the and for use using when default "
    "auto automatic more other options option all app apps phone galaxy samsung display black"
)

# --- Fixed values: retrieval --------------------------------------------------------
# Common English function words left out of TF-IDF; callers can pass their own list.
ENGLISH_STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below between "
    "both but by can cannot could did do does doing down during each few for from further had has have having he "
    "her here hers herself him himself his how i if in into is it its itself me more most my myself no nor not of "
    "off on once only or other ought our ours ourselves out over own same she should so some such than that the "
    "their theirs them themselves then there these they this those through to too under until up very was we were "
    "what when where which while who whom why will with would you your yours yourself yourselves"
)
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
ARTICLE_WEIGHTS = (0.5, 0.5)
ARTICLE_MIN_COSINE = 0.08
CATALOG_WEIGHTS = (0.8, 0.2)
POLARITY_TIE = 0.02
NEGATIVE_PHRASES = ["disable", "disables", "turn off", "switch off", "stop", "deactivate", "exit"]
SEARCH_EXPANSIONS = [
    # (phrase present, phrase that must not be present, words to add)
    ("quick access panel", None, "edge panels edge panel"),
    ("edge panel", "quick access panel", "quick access panels"),
    ("techcorp", None, "samsung"),
    ("samsung", "techcorp", "techcorp"),
    ("data transfer", None, "smart switch"),
    ("smart switch", "data transfer", "data transfer"),
]

# --- Fixed values: matching thresholds ----------------------------------------------
SEMANTIC_MIN = 0.85
GATED_MIN = 0.82
ARTICLE_MIN_SIMILARITY = 0.50
VARIANT_MIN_SIMILARITY = 0.60

# --- Fixed values: grounding --------------------------------------------------------
GROUNDING_STOP_WORDS = (
    "the a an is are was were to on in of for and or it will this that you your tap open go select click step"
)
GROUNDING_THRESHOLD = 0.20
GROUNDING_PIPELINE_THRESHOLD = 0.15

# --- Fixed values: step extraction --------------------------------------------------
CHATTER = (
    r"\b(?:go through (?:some|these|the following)|see if we can|help resolve this|"
    r"help you resolve|walk you through|we can resolve)\b"
)
DISCOURSE_OPENER = (
    r"^(?:first|firstly|next|then|now|also|finally|lastly|additionally|afterwards|after that|after charging|"
    r"once (?:done|complete|completed)|alternatively|to do this|to check this|in this case|simply|instead|"
    r"otherwise)\s*,?\s+"
)
SOFTENER = (
    r"^(?:please\s+|let'?s\s+|kindly\s+|you (?:can|could|may|might|should|will need to|need to|may need to|"
    r"can also|could also)\s+(?:also\s+)?|we recommend (?:that you )?|it(?:'s| is) (?:recommended|best) to\s+|"
    r"be sure to\s+|make sure to\s+)"
)
STATEMENT_OPENER = r"^(?:i |we |here'?s|this |these |that |it |there |your |the |an? |normal |note\b)"
CONDITION_OPENER = r"^(?:if|when|once|after|for|to|before|while)\b"
STEP_VERBS = (
    "access adjust allow back check choose clean clear close confirm connect contact create customize delete "
    "disable disconnect download drag eject enable ensure enter examine exit follow force go hold insert inspect "
    "install launch leave let locate log make move navigate open perform place plug power press reinsert remove "
    "rename reopen replace reset restart restore review run schedule scroll select send set shine sign slide start "
    "swipe switch take tap touch try turn uninstall unplug update use verify visit wait wipe"
)
MAX_ACTIONS, MAX_STEPS_PER_ACTION, MIN_STEP_WORDS, MAX_STEP_WORDS = 8, 6, 3, 40

CRITICAL_TERMS = [
    "factory data reset", "factory reset", "reset your", "reset the", "wipe", "erase", "force a restart",
    "force restart", "forcing a restart", "restart", "reboot", "safe mode", "software update", "software updates",
    "update the software", "firmware", "recovery mode",
]
CRITICAL_BODY_TERMS = [
    "factory data reset", "factory reset", "safe mode", "software update", "force a restart", "forcing a restart",
]
MANUAL_TERMS = [
    "inspect", "examine", "liquid", "physical damage", "charger", "charging port", "usb cable", "cable", "charge",
    "screen protector", "protective film", "case", "sim", "tray", "ejector", "flashlight", "remove the battery",
    "battery for", "service center", "service centre", "repair", "contact", "samsung support", "visit", "walk-in",
    "mail-in", "premium care", "on a pc", "computer", "usb mouse", "keyboard", "monitor", "adapter",
]
AUTO_TERMS = [
    "settings", "tap", "swipe", "toggle", "turn on", "turn off", "enable", "disable", "quick settings", "menu",
    "select", "edge panel", "navigation bar", "display", "accessibility", "icon", "app", "window", "drag",
    "home screen",
]
INFORMATIONAL_HEADING = (
    r"^(?:understanding|factors|about|overview|introduction|useful|why|what is|"
    r"troubleshoot(?:ing)?(?: steps)?(?: for)?|service options)\b"
)
SYMPTOM_TOPICS = {
    "flicker": ("Screen Flicker", "Screen flicker issue"),
    "blank": ("Blank Screen", "Blank screen issue"),
    "damage": ("Cracked Screen", "Cracked screen repair"),
    "slow": ("Touch Responsiveness", "Slow touch response"),
    "freeze": ("Frozen Screen", "Frozen screen issue"),
    "drain": ("Battery Drain", "Battery drain issue"),
    "overheat": ("Device Overheating", "Device overheating issue"),
}
COMPONENT_TOPICS = {
    "touch": ("Touchscreen", "Unresponsive touchscreen"),
    "brightness": ("Display Brightness", "Display brightness issue"),
    "charging": ("Charging", "Charging issue"),
    "screen_damage": ("Cracked Screen", "Cracked screen repair"),
    "wifi": ("Wi-Fi Connection", "Wi-Fi connection issue"),
    "bluetooth": ("Bluetooth Connection", "Bluetooth connection issue"),
}
DEFAULT_TOPIC = ("Display", "Display issue")
TITLE_DEVICE_PHRASE = r"\bon (?:a |an |your )?(?:samsung |galaxy )*(?:phone or tablet|phone|tablet)\b"
TITLE_BRAND = r"\b(?:samsung|galaxy)\b"
TITLE_OPENER = r"^(?:use|how to|some things to check first)\b"
DESCRIPTION_RULES = [
    (["factory data reset", "factory reset"], "It will restore factory default settings"),
    (["safe mode"], "It will isolate problems from downloaded apps"),
    (["software update", "update the software", "firmware", "updates"], "It will install the latest software fixes"),
    (["restart", "reboot"], "It will clear temporary glitches by restarting"),
    (["liquid", "physical damage", "inspect", "examine"], "It will rule out physical damage"),
    (["charge", "charger", "charging"], "It will restore battery power to start"),
    (["screen protector", "protective film", "case"], "It will remove accessories blocking touch input"),
    (["service center", "repair", "support", "premium care", "further assistance"],
     "It will connect you with Samsung repair"),
    (["back up", "backup", "smart switch", "transfer"], "It will keep your personal data safe"),
    (["touch sensitivity"], "It will improve touch response with protectors"),
    (["gesture", "navigation"], "It will adjust how screen gestures behave"),
    (["rotate", "rotation"], "It will control automatic screen rotation"),
    (["brightness", "dark mode", "display"], "It will adjust display settings for clarity"),
    (["wi-fi", "wifi", "connection", "network", "mobile data"], "It will verify your network connection works"),
    (["email", "account"], "It will reconnect your email account"),
    (["multi window", "pop-up", "app pair", "edge panel"], "It will manage split screen app windows"),
    (["mouse", "keyboard", "monitor"], "It will let you control it externally"),
    (["power on", "power button", "turn it on"], "It will check whether the device starts"),
]
DESCRIBE_LEAD = r"^(?:troubleshooting|troubleshoot|fixing|how to)\s+"
HEADING_VERBS = (
    "review remove disconnect check reset restart update clear turn adjust change enable disable connect reconnect "
    "install uninstall charge inspect clean back contact use set open close test customize manage delete sign "
    "reinstall free force boot try"
)
STEP_NAME_RULES = [
    (["screen protector"], "Remove the Screen Protector"),
    (["force", "restart"], "Force a Restart"),
    (["charge"], "Charge the Device"),
    (["inspect", "damage"], "Check for Physical Damage"),
    (["mouse", "keyboard"], "Connect a USB Mouse and Keyboard"),
    (["service", "support", "repair"], "Contact Samsung Support"),
    (["settings"], "Review Device Settings"),
]
DEFAULT_ACTION_NAME = "Review Device Settings"
DEFAULT_MANUAL_NAME = "Contact Samsung Support"
MINOR_WORDS = "a an the and but or for nor on at to from by with in of"

# --- Fixed values: screens and links ------------------------------------------------
NAV_CLAUSE = (
    r"\b(?i:tap(?:\s+on)?|go\s+to|navigate\s+to(?:\s+and\s+open)?|open|touch)\s+(?i:the\s+)?"
    r"([A-Z][\w\-]*(?:\s+[A-Za-z][\w\-]*){0,4}?)"
    r"(?=\s*(?:[,.;]|$|\s+and\b|\s+then\b|\s+to\b|\s+again\b|\s+icon\b|\s+option\b|\s+menu\b))"
)
NAV_FILLER = r"(?i)[,.;]|\b(?:and|then|and then|next)\b"
GENERIC_LABELS = ["settings", "settings menu", "the settings app", "settings app"]
LEAF_STOP_WORDS = (
    "enable disable view check adjust switch turn show this that with from your device settings setting page opens "
    "enables disables updates specified value via the and for option"
)
GESTURE_WORDS = "swipe tap open select touch hold press more options"
LINK_FLOOR, LINK_STRONG, LINK_CRITICAL = 0.05, 0.30, 0.10
FILTER_DISTRUST_SCORE, FILTER_DISTRUST_RAW = 0.3, 0.15
PAGE_TIE = 0.05
SCREEN_POOL = 40
PLACEHOLDER_SUFFIX = "://dummy_positive"
PLACEHOLDER_URI = "bixby://dummy_positive"
DEFAULT_SCHEME = "voiceassist"
LINK_SCHEMES = ["bixby", "voiceassist"]
PLACEHOLDER_LEAD_VERB = r"^(?:Adjust|Check|Review|Change|Turn|Use|Set)\s+"
CATEGORY_ORDER = {"auto": 0, "manual": 1, "critical": 2}

# --- Fixed values: rules and repair -------------------------------------------------
GOAL_PATTERN = r"^Follow these steps to perform this (.+) (Troubleshooting|Configuration)$"
GOAL_LEAD = r"^(?:Follow these steps to perform this|Steps to perform|Troubleshooting for)\s*"
GOAL_TAIL = r"\s*(?:Troubleshooting|Configuration)$"
RULE_VERBS = (
    "adjust allow back backup change check choose clear close confirm connect contact disable disconnect drag "
    "enable ensure enter follow go hold insert inspect install launch locate lock move navigate open perform "
    "pick plug power press provide reboot reconnect remove reset restart review run scroll select set slide start "
    "stop switch swipe tap test toggle turn unplug update use verify visit wait"
)
ABBREVIATIONS = "gps usb wi-fi wifi sim led ram os ai nfc sos"
DANGLING_WORDS = (
    "the a an and or to your for of with on in by from at its between into via due because than that which if when "
    "so as about through across over under"
)
DESCRIPTION_FILLER = "the a an your that very all any its"
URL_PATTERNS = {
    "markdown_link": r"\[([^\]]+)\]\((?:https?://|www\.)[^\s\)]+\)",
    "raw_url": r"(?:https?://|www\.)[^\s<>\"'\)]+",
    "scheme_url": r"https?://[^\s]+",
    "bare_domain": r"\b[a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:com|net|org|co|io|html?)\b(?:/[^\s<>\"')]*)?",
    "markdown_image": r"!\[[^\]]*\]\([^)]*\)",
    "link_tag": r"<\s*/?\s*a\b[^>]*>",
}
SCORE_WEIGHTS = {"grounding": 0.40, "validator": 0.30, "retrieval": 0.15, "path": 0.15}
ERROR_PENALTY = 0.15
LOW_CONFIDENCE = 0.25
RESULT_TYPES = ["boolean", "integer", "str", "float"]
CONDITIONS = ["greater", "equal", "less"]
CATEGORIES = ["auto", "manual", "critical"]

# --- Fixed values: paraphrases ------------------------------------------------------
MAX_VARIANTS = 10
CLAUSE_CUT = r"(?i)[,;:—\"]|\.\s|\s(?:so|and then|whenever|when|after|because|while|which|that)\s"
MODEL_WORDS = "my new samsung galaxy z flip fold ultra plus fe pro note tab edge lite s a m"
SUBJECT_NOUNS = "screen display touchscreen phone tablet device inner main outer cover phone's tablet's device's"
DANGLING_TAIL = "it where the and or a an of to my right again with tiny in"
TYPOS = [
    ("screen", "scren"), ("black", "blak"), ("blank", "blnak"), ("phone", "phnoe"), ("display", "dispaly"),
    ("flickers", "flikers"), ("cracked", "craked"), ("touch", "tuch"), ("working", "workin"),
    ("tablet", "tabelt"), ("turn", "trun"),
]
FRUSTRATED_OPENERS = ["Ugh, ", "Seriously, ", "This is so annoying — "]

# --- Fixed values: model prices, USD per million tokens (input, output) --------------
MODEL_PRICES = [
    ("gemini-2.5-flash", 0.30, 2.50), ("gemini-3.8-flash", 0.30, 2.50), ("ministral-8b-latest", 0.10, 0.10),
    ("openai/gpt-oss-120b", 0.15, 0.60), ("gemini-3.5-flash-lite", 0.10, 0.40),
    ("mistral-medium-latest", 0.40, 2.00), ("mistral-small-latest", 0.10, 0.30),
]
# Words left out of the step-accuracy stems.
ACCURACY_STOP_WORDS = (
    "open settings then your with from this that tap select turn the and for device phone galaxy samsung"
)


def word_list(text: str) -> list[str]:
    """Split a space-separated list once, keeping its order."""
    return text.split()
