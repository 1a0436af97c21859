"""Conversation queries over the ``conversations`` table."""

from __future__ import annotations

from ..operators import conversations as CV
from ..sources.tables import Tables
from .catalog import query

SYSTEM_PROMPT = "You are a careful equity research assistant. Answer from the data provided."


@query("q_last_message", """
select conv_id, turn, role, text from (
  select *, row_number() over (partition by conv_id order by turn desc) as rn from conversations)
where rn = 1""")
def q_last_message(spark, sf_dir):
    return CV.last_message(Tables(spark, sf_dir).conversations)


@query("q_with_system_prompt", f"""
select conv_id, turn,
       case when turn = min(turn) over (partition by conv_id) then 'system' else role end as role,
       case when turn = min(turn) over (partition by conv_id) then '{SYSTEM_PROMPT}' else text end as text
from conversations""")
def q_with_system_prompt(spark, sf_dir):
    return CV.with_system_prompt(Tables(spark, sf_dir).conversations, SYSTEM_PROMPT)


@query("q_transcripts", f"""
select conv_id, cast(floor(turn / {CV.PAGE_SIZE}) as integer) as page, count(*) as n_messages,
       cast(to_json(list({{'role': role, 'content': text}} order by turn)) as varchar) as messages
from conversations group by conv_id, floor(turn / {CV.PAGE_SIZE})""")
def q_transcripts(spark, sf_dir):
    return CV.transcripts(Tables(spark, sf_dir).conversations)


@query("q_conv_metrics", """
select a.conv_id, count(*) as n_turns,
       count(case when a.role = 'user' then 1 end) as n_user,
       count(case when a.role = 'assistant' then 1 end) as n_assistant,
       count(case when a.role = 'system' then 1 end) as n_system,
       round(avg(case when a.role = 'user' then length(a.text) end), 4) as avg_user_chars,
       round(avg(case when a.role = 'assistant' then length(a.text) end), 4) as avg_assistant_chars,
       count(case when a.role = 'user' and b.role = 'assistant' then 1 end) as n_answered
from conversations a left join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1
group by a.conv_id""")
def q_conv_metrics(spark, sf_dir):
    return CV.metrics(Tables(spark, sf_dir).conversations)
