"""Schemas of exports, of the chat model, and of the answers of the language-model analyses."""

#: A message of an export, and what stands around the messages.
MESSAGE = """
id STRING, timestamp BIGINT, time STRING, sender STRUCT<uid: STRING, name: STRING, nickname: STRING>,
type STRING, content STRUCT<text: STRING, elements: ARRAY<STRUCT<type: STRING, data: VARIANT>>>,
recalled BOOLEAN, system BOOLEAN, _corrupt_record STRING
"""
EXPORT_HEAD = """
chatInfo STRUCT<name: STRING, type: STRING, selfUid: STRING, selfName: STRING>,
statistics STRUCT<totalMessages: BIGINT, timeRange: STRUCT<`start`: STRING, `end`: STRING, durationDays: INT>,
                  senders: ARRAY<STRUCT<uid: STRING, name: STRING>>>,
_corrupt_record STRING
"""
#: One exported chat, one JSON object a file.
EXPORT = """
chatInfo STRUCT<name: STRING, type: STRING, selfUid: STRING, selfName: STRING>,
statistics STRUCT<totalMessages: BIGINT, timeRange: STRUCT<`start`: STRING, `end`: STRING, durationDays: INT>,
                  senders: ARRAY<STRUCT<uid: STRING, name: STRING>>>,
messages ARRAY<STRUCT<id: STRING, timestamp: BIGINT, time: STRING, sender: STRUCT<uid: STRING, name: STRING, nickname: STRING>,
                      type: STRING, content: STRUCT<text: STRING, elements: ARRAY<STRUCT<type: STRING, data: VARIANT>>>,
                      recalled: BOOLEAN, system: BOOLEAN>>,
_corrupt_record STRING
"""

MESSAGES = "chat_id STRING, seq BIGINT, id STRING, ts_ms BIGINT, time_str STRING, sender_name STRING, sender_uid STRING, is_self BOOLEAN, text STRING, raw_text STRING, msg_type STRING, has_image BOOLEAN, is_reply BOOLEAN, face_ids ARRAY<INT>, face_names ARRAY<STRING>"
CHATS = "chat_id STRING, chat_name STRING, self_name STRING, other_name STRING, self_uid STRING, other_uid STRING, total_count BIGINT, time_start STRING, time_end STRING, duration_days INT"

#: Answers by dimension. The first three are by month, the others by person.
EMOTION = "self_emotion STRING, self_intensity INT, self_keywords ARRAY<STRING>, other_emotion STRING, other_intensity INT, other_keywords ARRAY<STRING>, overall_tone STRING"
TOPICS = "topics ARRAY<STRUCT<name: STRING, weight: DOUBLE, keywords: ARRAY<STRING>>>, summary STRING, topic_shift_detected BOOLEAN, shift_description STRING"
RELATIONSHIP = "initiator_tendency STRING, initiator_ratio_self DOUBLE, interaction_style STRING, closeness_score INT, closeness_trend STRING, self_role STRING, other_role STRING, emotional_support_self_to_other STRING, emotional_support_other_to_self STRING, relationship_summary STRING"
HABITS = "personality_tags ARRAY<STRING>, common_phrases ARRAY<STRING>, top_emojis ARRAY<STRING>, unique_traits ARRAY<STRING>, emoji_style STRING, sentence_length STRING, reply_speed STRING, topic_jumping STRING"
_TEXTS = "MAP<STRING, STRING>"
PROFILE = f"name STRING, overall_impression STRING, verdict STRING, fun_facts ARRAY<STRING>, personality_analysis {_TEXTS}, chat_style_analysis {_TEXTS}, emotional_pattern {_TEXTS}, intelligence_indicators {_TEXTS}, relationship_dynamics {_TEXTS}, growth_observation STRUCT<has_changed: BOOLEAN, description: STRING, evidence: STRING>, scoring {_TEXTS}"
CONTRACTS = {"emotion": EMOTION, "topics": TOPICS, "relationship": RELATIONSHIP, "habits": HABITS, "profile": PROFILE}
MONTHLY, PERSONAL = ("emotion", "topics", "relationship"), ("habits", "profile")
