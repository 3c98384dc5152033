"""DataFrame operators, from detected words to reminder schedules."""
