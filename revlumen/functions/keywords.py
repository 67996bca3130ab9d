"""Keyword tables of the rule cascade.

All entries are matched as plain substrings of the lower-cased text, in the
order given. They are data: pass an edited ``RuleTables`` to ``classify`` to
extend them.
"""

from __future__ import annotations

from dataclasses import dataclass

# Word lists and scores that decide the labels.
FEATURE_KEYWORDS = (
    ("Crash Detection", ("crash detection", "detect crash", "car accident")),
    ("Driving Reports", ("driving report", "speeding rule", "driving score")),
    ("Family Location", ("location sharing", "family location", "gps tracker", "where is my kid",
                         "location not updating")),
    ("SOS", ("sos", "emergency alert")),
    ("Card Controls", ("card controls", "freeze card", "lock card", "card toggle")),
    ("Allowance/Chores", ("allowance", "chores", "task")),
    ("Savings/Investing", ("savings", "investing", "stock")),
    ("Bank Linking", ("bank link", "plaid", "link account", "deposit")),
    ("Notifications", ("notifications", "push alert")),
    ("Onboarding", ("onboarding", "sign up", "registration")),
    ("Login/OTP", ("login", "otp", "code", "password", "can't login", "cannot login")),
)
FEATURE_SCORE = 0.8

ISSUE_KEYWORDS = (
    ("Safety Concern", 0.9, ("safety", "alert failed", "stranger", "emergency", "sos not working")),
    ("Trust/Fraud", 0.9, ("scam", "fraud", "stole", "unauthorized", "fake charge", "identity theft")),
    ("Billing/Pricing", 0.8, ("charged", "charge", "refund", "billing", "subscription", "price", "fee",
                              "cancel subscription")),
    ("Payments/Transactions", 0.85, ("payment failed", "transfer failed", "card declined",
                                     "money missing", "balance wrong", "transaction")),
    ("Account/Auth", 0.85, ("can't login", "cannot login", "login failed", "otp", "password reset",
                            "account locked")),
    ("Data/Sync", 0.8, ("not syncing", "sync issue", "syncing", "data missing", "data disappeared",
                        "not updating")),
    ("Cancellation/Retention", 0.8, ("cancel", "cancellation", "unable to close",
                                     "can’t close account", "cannot close account")),
    ("Support/Service", 0.75, ("support", "customer service", "no response", "agent never replied",
                               "help center")),
    ("Bug", 0.7, ("bug", "error")),
    ("Performance", 0.7, ("slow", "lag", "freeze", "hang", "crash")),
    ("Feature Request", 0.8, ("feature request", "wish", "would be great if", "please add")),
    ("UX", 0.7, ("confusing", "hard to use", "unclear", "poor design")),
)

CRITICAL_PHRASES = (
    "can't login", "cannot login", "login failed", "account blocked", "money missing", "charged",
    "payment failed", "crashed on startup", "app won't open", "stuck on loading",
)
FRAUD_WORDS = ("scam", "fraud", "stole", "unauthorized")
SAFETY_FAILURE_PHRASES = (
    "crash detection not working", "didn't detect crash", "no alert sent", "location not updating",
    "stopped sharing location", "sos not working", "emergency alert failed",
    "not getting notifications",
)
BROKEN_WORDS = ("not working", "stopped", "fails", "failed", "broken")
SAFETY_MENTIONS = ("crash detection", "location", "gps", "sos", "alert")
SAFETY_AREAS = ("Crash Detection", "Family Location", "SOS")
DEGRADED_ISSUES = (
    "Bug", "Account/Auth", "Data/Sync", "Payments/Transactions", "Cancellation/Retention",
)
SLOWDOWN_ISSUES = ("Performance", "Unknown")
SLOWDOWN_WORDS = ("crash", "freeze", "lag", "hang")
PRAISE_WORDS = ("thanks", "love", "good")
MIN_LETTERS = 10

CRITICAL_SCORE = 0.9
SAFETY_SCORE = 0.95
MAJOR_SCORE = 0.85
MINOR_SCORE = 0.7
POSITIVE_SCORE, NEUTRAL_SCORE, NEGATIVE_SCORE = 0.8, 0.6, 0.8
SPAM_LABELS = ("Spam / Bot / Irrelevant", "Other", "FYI", "Neutral", 1.0)


@dataclass(frozen=True)
class RuleTables:
    """The editable part of the cascade."""

    features: tuple = FEATURE_KEYWORDS
    issues: tuple = ISSUE_KEYWORDS
    critical: tuple = CRITICAL_PHRASES
    fraud: tuple = FRAUD_WORDS
    safety_failure: tuple = SAFETY_FAILURE_PHRASES
    broken: tuple = BROKEN_WORDS
    safety_mentions: tuple = SAFETY_MENTIONS
    slowdown: tuple = SLOWDOWN_WORDS
    praise: tuple = PRAISE_WORDS


DEFAULT_TABLES = RuleTables()
