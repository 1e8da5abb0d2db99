"""Knowledge-base operators."""
