"""Patterns and word lists whose values fix the results, and their translation to Spark's regular expressions."""

from __future__ import annotations

import re

# Word and script classes.
MIN_WORDS = 3
ARABIC = "\\u0600-\\u06FF\\u0750-\\u077F\\uFB50-\\uFDFF\\uFE70-\\uFEFF"
TOKEN = f"[A-Za-z0-9{ARABIC}]+"
ROMAN_URDU_MARKERS = (
    "acha", "aya", "bohat", "gaya", "gayi", "hai", "hain", "ho", "kar", "kiya", "kya", "lagta", "lekin", "liye", "mein", "mera", "nahi", "raha", "rahi", "se", "wala", "waly", "yeh", "yahan",
)
LANGUAGES = ("urdu_script", "roman_urdu", "english", "code_switched")

# The wider Roman-Urdu word list of the demonstration's classifier.
WIDE_ROMAN_MARKERS = (
    "nahi|nhi|nai|hai|hy|hain|tha|thi|kar|kr|karo|gaya|gya|gaye|mera|meri|mujh|mujhe"
    "|apna|apni|kya|kyun|koi|kuch|paisay|paise|pese|bohat|bht|bhi|se|pe|par|jo|ke|ki|ka"
    "|dobara|phir|abhi|lekin|magar|raha|rha|rahe|diya|dea|liya"
)

# Money and loss words of the severity proxy, and what names something concrete.
MONEY = r"\b(rs|rupee|rupees|pkr|paisa|paisay|pesay|paise|balance|amount|money|transaction|transfer|payment|cash)\b"
LOSS = (
    r"\b(deduct|deducted|deduction|debited|cut|kat|kaat|katay|katy|kati|gaya|lost|missing|gayab|stolen|not\s+received|nahi\s+mila|nahi\s+aya|nahi\s+aaya"
    r"|not\s+credited|failed|fail|refund|wapis|stuck|scam|fraud)\b"
)
SPECIFIC = (
    r"\b(rs|rupee|rupees|pkr|otp|cnic|kyc|sim|loan|bill|agent|refund|transfer|deduct|deducted|kat|katay|login|password|pin|block|verif|package|bundle|network|signal"
    r"|internet|4g|cash)\b|[0-9]{2,}|روپے|او ٹی پی|بل|قرض|سم"
)

# Personal data, in order of priority; the named group is what is replaced.
PII = (
    ("email", r"(?P<pii>[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})"),
    ("iban", r"(?i)(?P<pii>PK\d{2}\s?[A-Z]{4}(?:\s?\d){16})(?!\d)"),
    ("cnic", r"(?<!\d)(?P<pii>\d{5}-\d{7}-\d)(?!\d)"),
    ("cnic", r"(?<!\d)(?P<pii>\d{13})(?!\d)"),
    ("cnic", r"(?<!\d)(?P<pii>\d{3}-\d{2}-\d{6})(?!\d)"),
    ("phone", r"(?<!\d)(?P<pii>(?:\+92|0092|92|0)?3\d{2}[-\s]?\d{7})(?!\d)"),
    ("phone", r"(?<!\d)(?P<pii>0\d{2,4}[-\s]\d{6,8})(?!\d)"),
    ("account", r"(?i)(?:\b(?:account|acct|a/c)\s*(?:number|no\.?|#)?|(?:اکاؤنٹ|اکاونٹ|حساب)\s*(?:نمبر)?)\s*[:=-]?\s*(?P<pii>\d(?:[- ]?\d){7,23})(?!\d)"),
    ("name", r"(?:\b[Mm]y name is|\bI am)\s+(?P<pii>[A-Z][A-Za-z'-]*(?:\s+[A-Z][A-Za-z'-]*){0,3})(?=$|[,.!?])"),
    ("name", r"(?i)\bmera na?am\s+(?P<pii>[A-Za-z][A-Za-z'-]*(?:\s+[A-Za-z][A-Za-z'-]*){0,3}?)\s+hain?\b"),
    ("name", r"میرا نام\s+(?P<pii>[\u0600-\u06FF]+(?:\s+[\u0600-\u06FF]+){0,3}?)\s+ہے"),
)
PLACEHOLDERS = {"email": "<EMAIL>", "cnic": "<CNIC>", "phone": "<PHONE>", "account": "<ACCOUNT>", "iban": "<IBAN>", "name": "<NAME>"}
OTHER_DIGITS, ASCII_DIGITS = "۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩", "01234567890123456789"
RISK_CUE = r"(?i)(?:@|\b(?:cnic|nic|iban|account|acct|phone|mobile|number|naam)\b|شناختی|اکاؤنٹ|اکاونٹ|فون|موبائل|نمبر|نام|(?:\d[-\s]?){5,})"

# Keyword groups, as (id, description, pattern).
KEYWORD_GROUPS = (
    ("money_lost", "money deducted or missing", r"\b(deduct|deducted|debited|kat gaya|kat gaye|kaat|katay|cut ho|missing|gayab|balance kam|paisay|paise|pese)\b|کٹ (گیا|گئے)|بیلنس کم|پیسے (کٹ|غائب)"),
    ("transfer", "transfers and payments", r"\b(transfer|send money|bheja|bhejay|receive nahi|nahi pohanch|not credited|ibft|raast)\b|ٹرانسفر|رقم بھیج|موصول نہیں"),
    ("otp", "OTP and verification codes", r"\b(otp|one[\s-]?time|verification code|code nahi|pin code)\b|او ٹی پی|تصدیقی کوڈ"),
    ("login", "sign-in and access", r"\b(login|log in|sign in|password|passcode|cannot access|access nahi)\b|لاگ ان|پاسورڈ|رسائی نہیں"),
    ("blocked", "blocked or frozen accounts", r"\b(block|blocked|freeze|frozen|suspend|band kar|bandh)\b|بلاک|بند کر|منجمد"),
    ("kyc", "KYC and CNIC verification", r"\b(kyc|cnic|nadra|verif|document|upgrade)\b|کے وائی سی|شناختی کارڈ|تصدیق"),
    ("card", "debit, credit and virtual cards", r"\b(debit|credit|visa|master ?card|atm card|virtual card|card)\b|کارڈ|ڈیبٹ"),
    ("fraud", "fraud, scam and impersonation", r"\b(fraud|scam|thag|thug|cheat|dhoka|hack|hacked|unauthori[sz]ed)\b|فراڈ|دھوکہ|ٹھگ|ہیک|جعلساز"),
    ("agent", "agents, retailers and cash-out", r"\b(agent|retailer|shop ?keeper|dukan|cash ?out|withdraw|nikal)\b|ایجنٹ|دکاندار|کیش آؤٹ|نکال"),
    ("support", "unanswered support", r"\b(helpline|help ?line|customer (care|support|service)|complain|no (response|reply)|jawab nahi|response nahi|koi response)\b|ہیلپ ?لائن|جواب نہیں|رسپانس نہیں"),
    ("network", "signal, data and outages", r"\b(signal|network|coverage|internet|4g|5g|slow|down|outage|maintenance)\b|سگنل|نیٹ ورک|انٹرنیٹ|سست|بند ہے"),
    ("bill", "bill payments", r"\b(bill|bijli|electric|gas bill|sui gas|utility)\b|بل|بجلی|سوئی گیس"),
    ("loan", "loans and instalments", r"\b(loan|qarz|qarza|udhaar|udhar|instal?ment|advance)\b|قرض|ادھار|قسط"),
    ("switching", "mentions leaving for a rival", r"\b(switch|shift|uninstall|delete|better than|instead of|chhor|chor diya|band kar diya)\b|چھوڑ|ان انسٹال|بہتر ہے"),
)

# Signal groups of intents that are seldom labelled; a text scores one for each group that it matches.
SIGNAL_GROUPS = (
    ("otp_not_received", (r"\botp\b|one[\s-]?time|verification code|او ٹی پی|تصدیقی کوڈ|کوڈ", r"nahi a+ya|nahi mila|nahi arha|not receiv|never receiv|didn'?t (get|receive)|نہیں آیا|نہیں آ ?رہا|نہیں ملا")),
    ("transfer_to_wrong_recipient", (r"wrong (number|account|person|recipient)|gal(a|u)t (number|numbar|account|banda)|غلط نمبر|غلط اکاؤنٹ|غلط بندے|غلط شخص", r"\bsent\b|transfer|bhej|چلے گئے|بھیج")),
    ("fake_payment_screenshot", (r"\bfake\b|jaali|jali|forged|doctored|جعلی|فیک|نقلی", r"screen ?shot|receipt|رسید|سکرین ?شاٹ|اسکرین ?شاٹ")),
    ("scam_impersonation_report", (r"imperson|pretend|posing as|khud ko .{0,25}(officer|staff|company|employee)|company ka (banda|aadmi|admi)|نمائندہ بن|افسر بن|عملہ بن", r"scam|fraud|thag|thug|دھوکہ|فراڈ|ٹھگ|جعلساز")),
    ("cash_out_agent_problem", (r"\bagent\b|retailer|dukan|shop ?keeper|ایجنٹ|دکاندار|دکان", r"cash ?out|withdraw|nikal|نکال|کیش ?آؤٹ|رقم نکل")),
    ("loan_repayment_dispute", (r"\bloan\b|qarz|qarza|udhaar|udhar|advance salary|قرض|ادھار", r"repay|instal?ment|rollover|auto.?deduct|extra charge|واپس|قسط|چارجز|سود")),
    ("harassment_or_abuse_via_platform", (r"gaali|gali (de|di)|abus|threat|harass|badtami?z|بدتمیز|گالی|دھمکی|تنگ کر|بےعزت",)),
    ("sim_or_number_issue", (r"\bsim\b|port (kar|karwa|ho)|number (change|port)|سم|پورٹ|نمبر تبدیل",)),
    ("account_compromised", (r"hack|unauthori[sz]ed|kisi aur ne|someone (else )?(used|logged|access|took)|ہیک|کسی اور نے|بغیر اجازت",)),
    ("bill_payment_not_reflected", (r"\bbill\b|bijli|electric|gas bill|بل|بجلی|سوئی گیس", r"not (show|reflect|updat|receiv|credit)|unpaid|abhi b?hi|نہیں دکھا|ادا نہیں|جمع نہیں")),
    ("information_request", (r"\?|kya h(ai|y)|kaise|kitna|kitne|how (do|can) i|what is|کیسے|کتنا|کیا ہے",)),
    ("refund_request", (r"refund|wapis|wapas|return my money|واپس|رقم واپس",)),
)


def to_java(pattern: str, ignore_case: bool = False) -> str:
    """A Python pattern for Spark: Unicode classes, named groups in Java's form, and Python's white space."""
    out = re.sub(r"\(\?P<", "(?<", pattern)
    out = re.sub(r"(?<!\\)((?:\\\\)*)\\s", r"\1[\\s\\x{1c}-\\x{1f}]", out)
    flags = "iU" if ignore_case or out.startswith("(?i)") else "U"
    return f"(?{flags})" + out.removeprefix("(?i)")
