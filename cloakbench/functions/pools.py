"""The pools from which attributes of generated prompts are drawn."""

from __future__ import annotations

# --- Fixed values: what a hard negative may hold -----------------------------------------------------
LOOKALIKES = [
    "SHA-256 hash", "MD5 hash", "UUID v4", "shipping tracking number", "order ID with digit and letter pattern", "invoice number", "MAC address",
    "IPv6 address", "git commit SHA", "build pipeline ID", "serial number", "ETag", "hex color or hex string",
]
LOOKALIKE_COUNTS = {1: 0.50, 2: 0.30, 3: 0.15, 4: 0.05}

# --- Fixed values: how a message begins --------------------------------------------------------------
LOWERCASE_OPENERS = [
    "i", "i need", "i want", "i'd like", "i was wondering", "i'm trying to", "im trying to", "im looking for", "im wondering", "im hoping to",
    "im not sure", "i need help with", "i want to know", "i cant figure out", "hey", "hey can you", "hi", "yo", "omg", "ok so", "so", "wait",
    "actually", "btw", "quick question", "quick q", "tldr:", "lazy question:", "dumb question:", "wondering if", "any idea", "any tips for",
    "any way to", "is there a way to", "is it possible to", "can i", "could i", "how do i", "how can i", "why does", "whats up with",
    "whats the deal with", "what's the best", "need help with", "looking for", "trying to", "thinking about", "got a question about", "remind me",
    "walk me through", "frustrated with", "confused about", "excited about", "worried about", "just got", "just bought", "just tried",
    "recently noticed", "explain how", "explain why",
]
TITLECASE_OPENERS = [
    "I", "I need", "I want", "I'm trying to", "I'm looking for", "I'm wondering", "I need help with", "I want to know", "How do I", "How can I",
    "What's the best", "What's a good", "Why does", "Why is", "Can you", "Could you", "Would you", "Help me", "Help me with", "Tell me", "Show me",
    "Give me", "Looking for", "Need help with", "Search for", "Find me", "Walk me through", "Remind me", "Got a question about", "Summarize the",
    "Explain how", "Explain why", "Just bought", "Just got", "Just tried", "Recently noticed", "Frustrated with", "Confused about", "Worried about",
]

# --- Fixed values: who writes, how, how much and about what ------------------------------------------
SCENARIOS = [
    "first-time user trying to figure something out", "frustrated user after a bad experience", "comparing options before making a purchase",
    "post-purchase support / dispute / refund question", "researcher gathering info for a project or paper", "automating a personal workflow",
    "writing or editing content (blog, email, document)", "helping a friend or family member figure something out",
    "in-a-hurry quick question, minimal context", "deep-diving / curious about a concept", "small-business owner asking for advice",
    "developer debugging or learning a new tool", "student doing homework or studying", "traveler planning or troubleshooting a trip",
    "parent juggling kid-related logistics",
]
TONES = [
    "short one-line question to the assistant", "casual help-seeking question", "longer detailed help request explaining context first",
    "polite clarification follow-up question", "brainstorming or ideation request", "summarize-this request that pastes data inline",
    "explain-it-to-me question", "venting or frustrated about something", "sharing a quick observation and asking for feedback",
    "asking for a recommendation",
]
LENGTHS = {"1 sentence": 0.30, "2-3 sentences only": 0.65, "a single paragraph (4-8 sentences)": 0.04, "2-3 short paragraphs": 0.01}
TOPICS = [
    "finance", "human resources", "daily usage", "engineering", "healthcare", "academia", "government", "entertainment", "sports", "technology",
    "business", "gaming", "advertisement", "social media", "marketing", "executive", "education", "travel", "food and recipes", "legal",
    "real estate", "personal productivity", "writing assistance", "translation", "research", "fitness and wellness", "parenting", "shopping",
    "customer service", "career", "investing", "automotive", "nonprofit", "music", "art and design", "science", "data analysis", "coding help",
    "devops", "cybersecurity", "machine learning", "product management", "logistics", "manufacturing", "retail", "hospitality", "insurance",
    "agriculture", "energy", "environment",
]

# --- Fixed values: how many values a positive message holds ------------------------------------------
PII_MIX = {"single": 0.70, "cluster": 0.15, "multi": 0.13, "many": 0.02}
