"""Output columns of every registered query, with the form they are compared in.

i = whole number, s = text, f = number rounded to 6 digits, b = boolean,
l = list of texts joined by commas in order, t = time as ISO text with milliseconds.
"""

SPEC = {
    # text analysis
    "tokens_standard": "id:i field:s pos:i term:s",
    "tokens_english": "id:i field:s pos:i term:s stem:s",
    "edge_ngrams": "id:i pos:i word:s gram:s",
    "autocomplete": "query_id:i rank:i id:i score:f",
    "field_variants": "id:i field:s analysis:s value:s",
    "cast_positions": "id:i pos:i term:s",
    "build_postings": "id:i field:s term:s tf:i dl:i positions:l",
    "vocab_stats": "field:s term:s df:i",
    "field_stats": "field:s n_docs:i avg_len:f",
    # ranked retrieval
    "bm25_match": "query_id:i field:s id:i score:f",
    "best_fields": "query_id:i id:i score:f",
    "fuzzy_expand": "field:s qterm:s term:s edits:i df:i weight:f",
    "cross_fields": "query_id:i id:i score:f",
    "term_match": "query_id:i id:i score:f",
    "phrase_match": "query_id:i field:s id:i freq:f score:f",
    "phrase_slop": "query_id:i field:s id:i freq:f score:f",
    "bool_should": "query_id:i id:i score:f",
    "signal_scores": "id:i popularity:f vote_count:f vote_average:f keyword_sum:f browse_sum:f",
    "date_decay": "id:i release_date:s keyword_decay:f browse_decay:f",
    "browse": "rank:i id:i score:f",
    "search": "query_id:i rank:i id:i score:f title:s genres:l vote_average:f release_date:s director:s",
    "search_page": "query_id:i rank:i id:i score:f",
    "search_cumulative": "query_id:i rank:i id:i score:f",
    "search_totals": "query_id:i total:i has_more:b",
    "similar_docs": (
        "query_id:i anchor:i rank:i id:i score:f title:s genres:l vote_average:f release_date:s"
    ),
    # filters, lookups, facets
    "filter_genres_any": "query_id:i id:i",
    "filter_rating_range": "query_id:i id:i",
    "post_filter": "query_id:i matched:i kept:i",
    "facet_genres": "query_id:i genre:s doc_count:i",
    "genres_overview": "key:s doc_count:i",
    "lookup_by_id": "query_id:i id:i found:b title:s director:s",
    "source_excludes": "id:i title:s overview:s",
    "normalize_requests": (
        "query_id:i query:s genres:l rating_min:f rating_max:f page:i page_size:i"
    ),
    "normalize_limits": "query_id:i limit:i",
    "display_columns": (
        "id:i year:i stars:i rating:f runtime_text:s language:s card_genres:l shown_keywords:l "
        "cast_initial:s votes_text:s card_image:s"
    ),
    "parse_release_date": "id:i release_date:s release_dt:s",
    # sources and sinks
    "id_export_scan": "id:i popularity:f",
    "latest_snapshot": "id:i popularity:f dt:s",
    "top_popular_ids": "id:i popularity:f",
    "detail_scan": "id:i title:s n_genres:i n_cast:i n_crew:i status_code:i malformed:b",
    "normalize_detail": (
        "id:s title:s overview:s release_date:s vote_average:f vote_count:i popularity:f genres:l "
        "runtime:i budget:i revenue:i poster_path:s original_language:s tagline:s keywords:l "
        "cast_names:l director:s"
    ),
    "array_pluck": "id:i genres:l keywords:l",
    "array_first_k": "id:i position:i name:s character:s order:i",
    "first_match": "id:i director:s",
    "reject_error_docs": "id:i reason:s status_code:i",
    "ids_join_detail": "id:i loaded:b title:s",
    "catalog_refresh": "id:s title:s popularity:f director:s",
    "load_tallies": "wanted:i loaded:i skipped:i",
    "upsert_by_id": "id:i title:s director:s",
    "append_generated_id": "id:s event_id:i",
    "bulk_pairs_sink": "value:s",
    "bulk_auto_ids": "value:s",
    "bulk_pairs_scan": "id:i title:s overview:s genres:l vote_count:i popularity:f",
    "bulk_outcome": "items:i indexed:i without_error:i failed:i",
    "table_count": "name:s rows:i",
    # logs
    "log_append": "event_id:i ts:t user_id:i event_type:s value:f props:s dt:s",
    "log_postings": "conv_id:i turn:i field:s term:s tf:i positions:l",
    # streams
    "stream_log_append": "event_id:i ts:t user_id:i event_type:s value:f props:s dt:s",
    "stream_dedupe": "event_id:i ts:t user_id:i event_type:s value:f props:s dt:s",
    "stream_upsert": "id:i title:s director:s",
}


def columns(name: str) -> list[tuple[str, str]]:
    return [tuple(c.split(":")) for c in SPEC[name].split()]
