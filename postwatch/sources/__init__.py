"""Inputs and outputs: stored posts, pages, scraped rows, HTML, delete events, generator."""
