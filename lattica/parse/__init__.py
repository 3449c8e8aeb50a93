"""A tolerant reader of JavaScript, TypeScript and JSX: text to tokens to facts. No Spark here."""
